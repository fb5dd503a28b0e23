"""Operators for preparing training text and vectors: sharding, scoring, tokenising, duplicate removal.

Nothing outside this subpackage imports it. ``registry`` lists its queries.
"""
