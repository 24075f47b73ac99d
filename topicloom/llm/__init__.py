"""Operators that prepare training text: filters, duplicates, nearest vectors, mixing, token ids."""
