"""Operators on records and documents."""
