"""Longitudinal text retrieval and ranking analytics on Spark DataFrames."""
