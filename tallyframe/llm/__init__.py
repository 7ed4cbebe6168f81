"""Operators for building training data, each written on PySpark DataFrames."""
