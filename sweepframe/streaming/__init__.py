"""The alerting path as Structured Streaming queries."""
