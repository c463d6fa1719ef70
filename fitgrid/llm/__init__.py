"""Operators for training data: search, tokens, quality, languages, copies, packing."""

from . import conversations as _conversations, queries as _queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
