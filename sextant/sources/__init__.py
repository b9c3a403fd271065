"""Sources of the code-map engine."""
