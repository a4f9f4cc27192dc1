"""Operators for large training corpora: mixing, sharding, packing, dedup, scoring.

Each operator has its own module and keeps a general interface; ``queries``
holds the thin ``opN_<name>`` queries and the SQL that checks them.
"""
