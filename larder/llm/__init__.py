"""Operators of a training-data pipeline: packing, joins, fingerprints, counts, filters and file formats.

Nothing outside this package imports it.
"""
