"""Corpus preparation for language models. Nothing else in the library imports this package."""
