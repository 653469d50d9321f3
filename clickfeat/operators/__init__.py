"""Operators: each takes DataFrames and returns a DataFrame (rows or columns added)."""
