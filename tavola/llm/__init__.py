"""Operators for training-data pipelines: near-duplicates, classifiers, tokens, mixing, search, extraction."""
