"""Operators for building training corpora: filters, duplicates, tokens, mixes and shards."""
