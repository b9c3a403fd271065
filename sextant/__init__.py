"""A code map and text analytics engine on Spark DataFrames."""
