"""loomwork: evidence-aware document and event analytics on Spark DataFrames."""
