"""Column-level building blocks; nothing in here triggers a Spark job."""
