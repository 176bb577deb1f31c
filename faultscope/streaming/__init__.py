"""Continuous forms of scoring, de-duplication and counting."""
