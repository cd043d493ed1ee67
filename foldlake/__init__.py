"""Search and comparison of three-dimensional chains as Spark jobs."""
