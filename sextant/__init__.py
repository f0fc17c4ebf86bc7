"""Search-assessment analytics on Spark DataFrames."""
