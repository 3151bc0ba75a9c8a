"""Operators on text corpora: token ids, packing and personal data. Nothing outside this package imports it."""
