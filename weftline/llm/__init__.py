"""Operators of a training-data pipeline: scans, sharding, packing, de-duplication, tokens, scores.

Nothing outside this subpackage imports it.
"""
