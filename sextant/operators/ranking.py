"""Places in one order of all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.session import settled


def placed(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """`rows` with `name`, their number from 1 in `order`: rows are sorted by ranges, and the
    counts of the ranges before its own give a row's number."""
    index = F.col("pl_id") % (1 << 33)
    ordered = settled(rows.orderBy(*order).withColumns({"pl_part": F.spark_partition_id(), "pl_id": F.monotonically_increasing_id()}))
    # One row a range.
    ahead = Window.orderBy("pl_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("pl_part").agg(F.count("*").alias("pl_n")).select("pl_part", F.coalesce(F.sum("pl_n").over(ahead), F.lit(0)).alias("pl_ahead"))
    return ordered.join(counts, "pl_part").withColumn(name, F.col("pl_ahead") + index + 1).drop("pl_part", "pl_id", "pl_ahead")
