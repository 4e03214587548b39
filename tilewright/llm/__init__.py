"""Operators for building training corpora: packing, deduplication, filters, search, archives, tokens."""
