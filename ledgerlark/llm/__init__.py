"""Operators for preparing training text: extraction, packing, scans, mixing, labelling, deduplication.

Nothing else in the library imports this subpackage.
"""
