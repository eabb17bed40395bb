"""Operators for building training corpora: deduplication, labelling, scoring, packing.

Nothing else in the library imports this subpackage.
"""
