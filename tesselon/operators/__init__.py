"""DataFrame operators: each is a function of DataFrames and parameters that returns a DataFrame."""
