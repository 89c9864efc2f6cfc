"""Incremental forms of the pipelines on Structured Streaming."""
