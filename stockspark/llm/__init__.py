"""Operators for large training-data corpora: dedup, decontamination, tokens, mixing, scoring, archives, search."""
