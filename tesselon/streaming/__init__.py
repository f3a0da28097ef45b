"""Incremental forms of batch operators for Structured Streaming."""
