"""Lanefold: batch-first hybrid retrieval and evaluation analytics on Spark DataFrames."""
