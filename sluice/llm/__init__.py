"""Operators for preparing text corpora: dedup, archives, filters, mixing, sharding and counts."""
