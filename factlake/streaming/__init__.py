"""Structured Streaming around the append-only sinks."""
