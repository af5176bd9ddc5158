"""Operators for preparing training text; nothing outside this package depends on it."""
