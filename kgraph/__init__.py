"""Knowledge-graph building, querying and retrieval on Spark DataFrames."""
