"""Structured Streaming versions of the activity operators."""
