"""Spark-first analytics for gridded, labelled, multi-dimensional data."""
