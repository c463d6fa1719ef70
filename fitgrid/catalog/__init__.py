"""Registered queries with their SQL equivalents, one module per operator group."""

from __future__ import annotations

from importlib import import_module

from .base import QUERIES, SQL

for _name in ("analytics", "features", "splits", "quality", "models", "machines", "trees", "io", "text"):
    import_module(f"{__name__}.{_name}")

__all__ = ["QUERIES", "SQL"]
