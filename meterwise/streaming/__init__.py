"""Incremental forms of the feature refresh and the document feed.

Each stream keeps mergeable partial rows in a table, so that exact results come
from the same functions as in batch.
"""
