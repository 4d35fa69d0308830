"""Structured Streaming twins of the replay operators."""
