"""Ordered-interval analytics on Spark DataFrames."""
