"""tillworks: point-of-sale analytics as Spark DataFrame and streaming jobs."""
