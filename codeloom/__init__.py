"""codeloom: code-graph analytics on Spark DataFrames."""
