"""Operators of a training-data pipeline: fingerprints, tokens, packing, dedup, language, secrets, shards.

Nothing else in the library imports this package. `queries` registers one query per operator.
"""
