"""Incremental processing with Structured Streaming (B2)."""
