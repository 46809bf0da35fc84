"""Order-book and event analytics on PySpark DataFrames."""
