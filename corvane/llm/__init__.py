"""Operators for preparing training text: joins, fingerprints, filters, packing, dedup, tokens, shards."""
