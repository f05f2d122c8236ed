"""Document search, curation and corpus preparation on Spark DataFrames."""
