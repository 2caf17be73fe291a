"""Structured Streaming ingestion with expiring state."""
