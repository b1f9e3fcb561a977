"""Drainage-data operators on Spark DataFrames."""
