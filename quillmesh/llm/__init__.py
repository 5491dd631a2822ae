"""Training-data operators: tokenisation, counting, filtering, deduplication, mixing.

Nothing outside this package imports it.
"""
