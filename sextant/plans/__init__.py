"""Plans of the code-map engine."""
