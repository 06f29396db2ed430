"""Operators of a training-data pipeline, on DataFrames.

Each module holds one operator with its own interface; ``queries`` has
the registered queries built on them.
"""
