"""Operators for building training data: dedup, filters, mixing, tokens, shards."""
