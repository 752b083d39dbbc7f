"""Whole queries over the supplied tables."""
