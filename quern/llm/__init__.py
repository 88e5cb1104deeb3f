"""Operators for preparing language-model training data at scale.

Nothing outside this package imports it; ``queries.py`` holds its registered
queries and their SQL counterparts.
"""
