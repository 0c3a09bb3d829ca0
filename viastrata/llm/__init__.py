"""Operators that prepare training data: tokenizing, scoring, cleaning, deduplicating and packing text."""
