"""Grouped decision-forest scoring and the data work around it, on Spark."""
