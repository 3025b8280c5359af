"""Sensitive-text analytics on PySpark DataFrames."""
