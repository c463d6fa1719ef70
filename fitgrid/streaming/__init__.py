"""Scoring rows as they arrive."""

from .score import score_stream

__all__ = ["score_stream"]
