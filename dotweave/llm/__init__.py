"""Operators of a training-data pipeline, each a DataFrame in, DataFrame out function.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries over the given tables.
"""
