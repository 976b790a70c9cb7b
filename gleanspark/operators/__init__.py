"""Operators on DataFrames of reviews."""
