"""recollect: retrieval and long-term-memory analytics on Spark DataFrames."""
