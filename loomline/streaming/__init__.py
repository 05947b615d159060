"""Change feeds and running statistics with Structured Streaming."""
