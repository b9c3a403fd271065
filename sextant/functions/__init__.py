"""Functions of the code-map engine."""
