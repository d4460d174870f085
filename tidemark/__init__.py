"""tidemark: behavioural event analytics on Spark DataFrames."""
