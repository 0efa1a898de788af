"""Linked-data analytics on Spark DataFrames."""
