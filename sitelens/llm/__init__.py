"""Training-data operators: dedup, packing, quality, mixing, sharding, formatting.

Nothing outside this folder imports it.
"""
