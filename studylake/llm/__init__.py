"""Operators for training data: extraction, tokens, filters, duplicates, search."""
