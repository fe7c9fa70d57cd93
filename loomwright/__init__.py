"""Document-feed analytics as DataFrame, SQL and Structured Streaming pipelines."""
