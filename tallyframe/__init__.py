"""Analytics jobs written directly on PySpark DataFrames."""
