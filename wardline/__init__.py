"""Point-in-time clinical record analytics on Spark DataFrames."""
