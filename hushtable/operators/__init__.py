"""Relational operators of the release pipeline."""
