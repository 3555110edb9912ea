"""tracemill: storing and searching program-execution traces with Spark."""
