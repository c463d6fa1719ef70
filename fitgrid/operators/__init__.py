"""Distributed operators: features, splits, statistics, rankings and quality."""
