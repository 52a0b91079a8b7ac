"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage.  Every module holds one
operator; ``queries.py`` registers the thin queries over whole tables.
"""
