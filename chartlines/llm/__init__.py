"""Operators for training-data corpora: near-duplicates, tokens, quality, language, mixing."""
