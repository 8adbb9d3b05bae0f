"""Transaction-stream analytics written as Spark DataFrame jobs."""
