"""Set-at-a-time document retrieval analytics on Spark DataFrames."""
