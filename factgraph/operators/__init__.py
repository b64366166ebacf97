"""Operators over fact tables: DataFrames in, DataFrames out."""
