"""Resolve of the code-map engine."""
