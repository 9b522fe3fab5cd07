"""Operators: DataFrames and arguments in, a DataFrame out."""
