"""Operators for large text corpora: search, dedup, scoring, tokenizing, mixing.

Nothing else in the library imports this subpackage.
"""
