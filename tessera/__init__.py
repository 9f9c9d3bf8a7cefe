"""Document pipelines compiled to Spark DataFrames."""
