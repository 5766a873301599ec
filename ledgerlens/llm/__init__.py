"""Operators for training-data pipelines: deduplication, packing, search, sharding, scans, archives, tokens, chat."""
