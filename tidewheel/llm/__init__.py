"""Operators that prepare text records for language-model training. Nothing outside imports this package."""
