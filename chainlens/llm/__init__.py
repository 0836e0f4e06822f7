"""Operators of a training-data pipeline over ``documents``.

Every operator is a function from DataFrames to a DataFrame; the ``opN_*`` query of an
operator lives in the same module and derives the contract's columns from its output.
Nothing outside this package imports it.
"""
