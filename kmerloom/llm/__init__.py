"""Training-data operators: deduplication, search, filtering, mixing and tokenisation.

Nothing outside this subpackage imports it.
"""
