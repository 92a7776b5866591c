"""Operators that prepare training text: filters, private data, search, copies, packing, tokens."""
