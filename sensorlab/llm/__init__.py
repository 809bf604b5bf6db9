"""Operators that prepare training text: filters, near-duplicates, packing, scoring."""
