"""Operators on DataFrames: indexing, refresh, retrieval, ranking, suggestions, links."""
