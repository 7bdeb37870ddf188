"""Document analytics, retrieval and evaluation as Spark DataFrames."""
