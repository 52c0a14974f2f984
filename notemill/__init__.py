"""Document and note analytics on Spark DataFrames."""
