"""Structured Streaming versions of the chunk and vote flows."""
