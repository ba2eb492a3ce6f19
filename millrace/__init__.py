"""millrace: corpus indexing, retrieval and preparation as Spark jobs."""
