"""Operators for training-data pipelines: secrets, dedup, tokens, links, mixing, language, quality, media."""
