"""Operators that prepare training text and vectors at scale. Nothing else in the library imports this package."""
