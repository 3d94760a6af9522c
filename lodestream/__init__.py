"""Lodestream: full-text search, ranking and training-data operators on Spark DataFrames."""
