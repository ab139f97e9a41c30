"""Joins, comparisons and groupings on DataFrames."""
