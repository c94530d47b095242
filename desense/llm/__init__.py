"""Corpus operators: language, quality, near duplicates, packing, tokens, search."""
