"""Operators over a repository's records, each a function from DataFrames to DataFrames."""
