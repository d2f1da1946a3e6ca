"""Operators for building training corpora: scoring, filtering, de-duplication, tokenising, sharding.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries.py`` applies them to the standard tables.
"""
