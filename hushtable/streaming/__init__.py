"""Incremental variants of the counts."""
