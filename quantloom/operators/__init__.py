"""Operators on long tables (dt, asset, value): pure functions from DataFrames to DataFrames."""
