"""Operators on training text: dedup, scoring, extraction, encoding and mixing of documents."""
