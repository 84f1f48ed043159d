"""Street-network analytics as Spark DataFrame jobs."""
