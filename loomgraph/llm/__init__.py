"""Training-data operators: sharding, scans, deduplication, tokens, quality, packing.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
