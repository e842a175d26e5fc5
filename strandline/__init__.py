"""Entity-presence analytics expressed as Spark DataFrame jobs."""
