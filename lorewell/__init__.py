"""Knowledge-base ingestion, retrieval and quality analytics as Spark jobs."""
