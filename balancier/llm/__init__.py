"""Operators for large text corpora: fingerprints, joins, dedup, encoding, packing, archives.

Nothing else in the library imports this package.
"""
