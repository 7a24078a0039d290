"""Operators for large-scale text corpora: quality, deduplication, classification, mixing and packing.

Nothing outside this package imports it. ``queries`` registers one query per operator.
"""
