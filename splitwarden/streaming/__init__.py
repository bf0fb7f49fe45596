"""Structured Streaming: ingest of run records, and label counts over time."""
