"""Source-code audit as Spark DataFrame jobs."""
