"""Operators on DataFrames: each takes and returns DataFrames."""
