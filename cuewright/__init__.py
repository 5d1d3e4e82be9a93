"""Timed-text and dubbing-data operators on Spark DataFrames."""
