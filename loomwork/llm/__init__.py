"""Training-data operators: sharding, quality, search, joins, dedup, toxicity, packing, mixing, ANN and HTML extraction.

Nothing outside this subpackage imports it.
"""
