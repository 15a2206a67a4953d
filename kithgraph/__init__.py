"""Photo-and-people analytics as Spark jobs."""
