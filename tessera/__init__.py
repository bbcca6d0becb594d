"""Catalog analytics for media datasets on Spark."""
