"""Corpus operators for training data: near-duplicates, scoring, packing, sharding, mixing, fingerprints, scans, search."""
