"""Tidy-cube climate analytics on Spark DataFrames."""
