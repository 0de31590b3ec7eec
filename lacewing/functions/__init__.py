"""Helpers on DataFrames."""
