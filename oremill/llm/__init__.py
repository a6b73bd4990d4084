"""Operators for preparing training text: filters, near-duplicate joins, mixing, tokens."""
