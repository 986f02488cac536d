"""Incremental work over Structured Streaming."""
