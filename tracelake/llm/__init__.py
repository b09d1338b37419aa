"""Training-data operators: deduplication, filtering, mixing, tokenising, search.

Nothing else in the library imports this subpackage.
"""
