"""Notice analytics expressed as Spark DataFrame, SQL and Structured Streaming plans."""
