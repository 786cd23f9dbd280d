"""Incremental (Structured Streaming) forms of batch tables."""
