"""Corpus operators for large-scale training data (ten operators + helpers).

Nothing else in the library imports this subpackage; ``queries`` registers one
query per operator and ``corpus_pipeline`` (repository top) chains five.
"""
