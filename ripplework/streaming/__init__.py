"""Structured Streaming versions of the time-based operators."""
