"""Operators for preparing training data: tokens, shards, secrets, duplicates, filters, packing.

The rest of the library never imports this package.
"""
