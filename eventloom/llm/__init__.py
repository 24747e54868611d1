"""Operators on text corpora: filtering, deduplication, mixing, packing and placement of documents."""
