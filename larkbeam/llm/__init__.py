"""Operators for preparing training data: text, media, tokens and vectors."""
