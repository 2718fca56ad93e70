"""Structured Streaming entry points built on the batch steps."""
