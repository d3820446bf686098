"""Operators, DataFrames to DataFrame."""
