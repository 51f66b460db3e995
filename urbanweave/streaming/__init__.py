"""Incremental month loading on Structured Streaming."""
