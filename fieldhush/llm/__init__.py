"""Operators for preparing training text: mixing, deduplication, packing, archives, scoring and token files."""
