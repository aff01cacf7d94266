"""Operators of a training-data pipeline (deduplication, tokens, packing, filters).

Nothing outside this folder imports it, and it imports nothing from the rest
of the library.
"""
