"""Incremental twins of the batch operators on Structured Streaming."""
