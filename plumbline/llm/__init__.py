"""Training-data operators: quality, deduplication, scoring, mixing and placement.

Nothing else in the library imports this subpackage.
"""
