"""Corpus-preparation operators for training data; nothing else in quillet imports this package."""
