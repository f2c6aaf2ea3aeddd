"""Corpus operators for training data: filters, fingerprints, deduplication, mixing, packing, sharding."""
