"""Interval and chain analytics on PySpark DataFrames."""
