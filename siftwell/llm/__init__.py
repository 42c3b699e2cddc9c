"""Operators for preparing training data: cleaning, de-duplication, sharding, formatting, tokens and packing."""
