"""Comparison operators: tables by key, documents by structure."""
