"""Operators over attempts: DataFrames and plain parameters in, DataFrames out."""
