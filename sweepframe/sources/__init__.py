"""Readers and writers for landed files."""
