"""Operators on graphs: DataFrames in, DataFrames out."""
