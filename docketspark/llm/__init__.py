"""Operators for large training corpora: fingerprints, deduplication, filtering, mixing and counting."""
