"""Repository-evidence analytics as Spark DataFrame jobs."""
