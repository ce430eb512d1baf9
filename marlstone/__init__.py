"""Corpus preparation and hybrid retrieval as DataFrame transformations."""
