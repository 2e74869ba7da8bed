"""Operators for preparing training data: cleaning, deduplication, mixing, formatting, tokens and scores."""
