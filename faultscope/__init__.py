"""Incident-text analytics as plain PySpark functions."""
