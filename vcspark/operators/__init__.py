"""Relational operators as functions from DataFrames to DataFrames."""
