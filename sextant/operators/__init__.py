"""Operators of the code-map engine."""
