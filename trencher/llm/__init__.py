"""Operators of a training-data pipeline: packing, dedup, filtering, scoring, sharding.

Nothing else in the package imports this subpackage.
"""
