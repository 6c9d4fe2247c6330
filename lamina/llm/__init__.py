"""Operators of a training-data pipeline: mixing, near-dedup, language ID, PII, secrets, packing, search, quality, licences.

Nothing outside this folder imports it; ``queries.py`` lists its queries and their SQL.
"""
