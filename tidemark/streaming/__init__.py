"""Structured Streaming: blind replay, commit barrier, delayed labels."""
