"""Operators for preparing training text at scale: deduplication, extraction, scoring, mixing, search.

Nothing else in the library imports this subpackage.
"""
