"""Corpus operators for training data: filtering, deduplication, encoding, archives."""
