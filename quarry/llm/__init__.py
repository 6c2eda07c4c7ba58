"""Operators for preparing training text and for counts too large to hold; nothing outside imports this package."""
