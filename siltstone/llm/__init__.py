"""Training-data operators: deduplication, scoring, mixing, search and sharding.

Nothing outside this subpackage imports it.
"""
