"""Operators on training text: documents in, one row per document, piece or class out."""
