"""vantloom: vector search and data preparation on Spark DataFrames."""
