"""Operators on streams, which also run on tables."""
