"""Operators of a training-data pipeline; each module states its results in its docstring.

Nothing outside this subpackage imports it.
"""
