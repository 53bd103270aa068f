"""Operators for cleaning and measuring training text; nothing else in the package imports this."""
