"""String-graph indexing and search as Spark jobs."""
