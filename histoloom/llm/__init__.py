"""Corpus operators for training data: packing, deduplication, sharding, decontamination, scoring, search."""
