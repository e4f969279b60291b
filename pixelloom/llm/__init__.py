"""Operators for training-data pipelines: filtering, deduplication, mixing, search and token output."""
