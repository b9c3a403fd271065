"""Streaming of the code-map engine."""
