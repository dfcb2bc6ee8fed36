"""XML and tolerant HTML analytics on Spark DataFrames."""
