"""Training-data operators: quality, dedup, search, mixing, packing, language and toxicity.

Nothing else in the library imports this subpackage.
"""
