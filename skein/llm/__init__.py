"""Operators for training-data pipelines.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries.py`` binds them to the tables under a
scale-factor folder.
"""
