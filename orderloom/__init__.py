"""Order matching and operations analytics on Spark DataFrames and streams."""
