"""tickloom: market-data analytics expressed as Spark DataFrame jobs."""
