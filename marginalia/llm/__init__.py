"""Operators for preparing training data: splitting, similarity search, clean text, matching by time,
near-duplicates, leak detection, mixing and residue. Nothing outside this package imports it."""
