"""Operators for preparing training data: deduplication, scoring, packing, decontamination.

Nothing else in the library imports this subpackage.
"""
