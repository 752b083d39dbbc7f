"""Functions that return columns."""
