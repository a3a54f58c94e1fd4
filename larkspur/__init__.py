"""larkspur: record analytics on Spark DataFrames."""
