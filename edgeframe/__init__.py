"""Call-graph analytics on Spark DataFrames."""
