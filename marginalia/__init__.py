"""Marginalia: searching, checking and curating a corpus of short notes, on Spark."""

__version__ = "0.1.0"
