"""Operators for text and record corpora; nothing outside this package imports it."""
