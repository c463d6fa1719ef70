"""Column expressions: parsing, targets, arrays, units and text formats."""

from .arrays import (
    argmax,
    cross_entropy,
    dot,
    normalise_array,
    squared_distance,
    vote_first_positive,
)
from .scalars import (
    above_target,
    clipped_delta,
    delta,
    eq_target,
    one_vs_others,
    size_class,
    to_double,
    to_gb,
    to_mb,
)
from .text import (
    compact_stamp,
    epoch_seconds,
    file_stem,
    fmt_mean_std,
    long_stamp,
    thousands,
    title_case,
)

__all__ = [n for n in dir() if not n.startswith("_")]
