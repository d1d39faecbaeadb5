"""Operators on training data: vectors, markup, near-duplicates, splitting, leaks, mixtures, repetition."""
