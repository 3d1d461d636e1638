"""veldt: governed analytics on Spark DataFrames."""
