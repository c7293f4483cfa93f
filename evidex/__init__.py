"""Evidence-backed knowledge analytics, written as Spark DataFrame and SQL jobs."""
