"""Hierarchical event data analytics on PySpark DataFrames."""
