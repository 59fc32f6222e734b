"""Operators of a training-data pipeline, each a function over DataFrames.

Nothing else in the library imports this subpackage.
"""
