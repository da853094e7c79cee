"""Operators of a training-data pipeline: mixing, packing, deduplication, filters, search.

Nothing else in the library imports this subpackage.
"""
