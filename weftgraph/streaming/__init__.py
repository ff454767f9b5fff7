"""Incremental ingestion and stateful operators on Structured Streaming."""
