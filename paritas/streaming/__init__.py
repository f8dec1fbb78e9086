"""Structured Streaming twins of the change-data operators."""
