"""Keyed data structures and approximate analytics on Spark DataFrames."""
