"""Hotel revenue analytics on Spark DataFrames."""
