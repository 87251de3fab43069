"""Operators for preparing large text corpora: deduplication, filtering,
fingerprints, tokenising, packing and archive rewriting."""
