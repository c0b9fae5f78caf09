"""Readers of source files and writers of derived tables."""
