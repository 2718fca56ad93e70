"""Composed jobs and answers: store, ingest, traffic queries, reports."""
