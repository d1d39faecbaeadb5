"""Readers, parsers of external formats, and the shared storage that jobs commit to."""
