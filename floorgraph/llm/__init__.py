"""Operators for large training-data corpora; nothing outside this package imports it."""
