"""Structured Streaming forms of the snapshot sink."""
