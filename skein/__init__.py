"""Skein: graph pattern queries with large outputs, on Spark DataFrames."""
