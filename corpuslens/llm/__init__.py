"""Operators for building training data: quality, language, duplicates, contamination, extraction, mixing."""
