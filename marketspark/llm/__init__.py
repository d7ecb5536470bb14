"""Operators that prepare text for training: archives, filters, duplicates, extraction and encoding."""
