"""Operators for large text corpora: duplicates, counts, scores, mixes, packing and shards."""
