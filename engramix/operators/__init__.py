"""Relational operators: every one is a function from DataFrames to a DataFrame."""
