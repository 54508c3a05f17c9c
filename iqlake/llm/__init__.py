"""Training-data operators: deduplication, packing, sharding, extraction, filtering.

Nothing else in the library imports this subpackage.
"""
