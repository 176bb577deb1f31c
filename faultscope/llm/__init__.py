"""Operators for preparing training corpora; nothing outside this package and ``corpus_pipeline`` imports it."""
