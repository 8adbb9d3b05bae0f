"""Corpus operators: deduplication, search, encoding, scoring and sharding of text collections."""
