"""Training-data operators: quality, near duplicates, scoring, PII, mixing, encoding.

Nothing else in the library imports this subpackage.
"""
