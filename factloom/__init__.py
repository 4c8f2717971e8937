"""Evidence analytics as Spark jobs."""
