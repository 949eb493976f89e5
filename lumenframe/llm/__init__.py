"""Training-data operators: filtering, deduplication, mixing, search and tokenisation.

Nothing outside this package imports it.
"""
