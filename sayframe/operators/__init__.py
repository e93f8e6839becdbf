"""Operators on units: DataFrames in, DataFrames out."""
