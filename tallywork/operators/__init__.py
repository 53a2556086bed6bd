"""Operators: DataFrames in, a DataFrame out, nothing run on the driver."""
