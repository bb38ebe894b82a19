"""Genome annotation analytics on Spark DataFrames."""
