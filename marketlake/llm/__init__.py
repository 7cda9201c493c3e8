"""Operators that prepare text corpora for training: deduplication, filters, packing, scoring."""
