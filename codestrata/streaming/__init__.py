"""Structured Streaming over files as they arrive."""
