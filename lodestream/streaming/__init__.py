"""Refresh of a stored index from a stream of crawls."""
