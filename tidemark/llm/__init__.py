"""Training-data operators: extraction, archives, tokenization, packing, deduplication,
language identification, sharding and nearest neighbours.

Nothing outside this subpackage imports it.
"""
