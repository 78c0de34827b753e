"""Operators for preparing training data: mixing, tokens, duplicates, personal data, quality, language."""
