"""Operators on annotated notes and on text corpora. Nothing outside this package imports it."""
