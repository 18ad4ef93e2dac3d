"""Structured Streaming additions: continuous ingest and a verdict histogram."""
