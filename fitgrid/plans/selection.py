"""Exact k-th row of a total order, without a global sort.

A split or a percentile needs one or two order statistics, not a sorted table.
Each pass narrows an open interval around the wanted position with
``percentile_approx`` (a mergeable sketch) and counts exactly what lies on
either side; three passes reduce 10^12 rows to a few hundred. Only the order
columns are scanned and nothing is shuffled but partial aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

SORT_BELOW = 200_000
ACCURACY = 10_000
SAMPLE = 4_000


def ordinal(df: DataFrame, name: str) -> Column:
    """Number that orders like the column; strings are returned as they are."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.unix_date(col)
    if isinstance(kind, T.BooleanType):
        return col.cast("int")
    return col


# Proposes an interval for position k of a column's values between two bounds.
Narrow = Callable[[object, object, int, int], tuple]


def kth_row(
    df: DataFrame,
    order_by: Sequence[str],
    k: int,
    total: int | None = None,
    sort_below: int = SORT_BELOW,
    narrow: Narrow | None = None,
) -> tuple:
    """Ordinals of ``order_by``, which holds no nulls, in the row at 1-based position ``k``.

    ``narrow(floor, ceiling, k, inside)`` replaces the sketch for a leading
    column whose distribution is known. Whatever it proposes is counted exactly,
    so it decides about speed only.
    """
    names = list(order_by)
    keys = df.select(*[ordinal(df, n).alias(f"o{i}") for i, n in enumerate(names)])
    inside = keys.count() if total is None else total
    if not 1 <= k <= inside:
        raise ValueError(f"position {k} is outside 1..{inside}")
    return tuple(_descend(keys, keys.columns, k, inside, sort_below, narrow))


def _sketch(scope: DataFrame, head: Column, k: int, inside: int) -> tuple:
    share, slack = k / inside, 2.0 / ACCURACY
    wanted = [max(0.0, share - slack), min(1.0, share + slack)]
    return tuple(scope.agg(F.percentile_approx(head, wanted, ACCURACY)).first()[0])


def _sample(scope: DataFrame, head: Column, k: int, inside: int) -> tuple:
    """The same proposal for text, from a sorted sample of bounded size; exact counts decide."""
    rows = scope.select(head.alias("v")).sample(fraction=min(1.0, SAMPLE / inside), seed=inside).collect()
    values = sorted((r["v"] for r in rows), key=lambda v: v.encode())
    if not values:  # a very unlikely draw: any value keeps the search going
        return (scope.select(F.min(head)).first()[0],) * 2
    place, slack = k / inside * len(values), 2.5 * len(values) ** 0.5
    return values[max(0, int(place - slack))], values[min(len(values) - 1, int(place + slack))]


def _descend(
    keys: DataFrame, cols: list[str], k: int, inside: int, sort_below: int, narrow: Narrow | None = None
) -> list:
    head = F.col(cols[0])
    numeric = isinstance(keys.schema[cols[0]].dataType, T.NumericType)
    text = isinstance(keys.schema[cols[0]].dataType, T.StringType)
    if inside > sort_below and not (numeric or text) and narrow is None:
        raise TypeError("the leading order column must be a number, date, timestamp or text")
    propose = _sample if text else _sketch
    scope, floor, ceiling = keys, None, None
    while inside > sort_below:
        low, high = narrow(floor, ceiling, k, inside) if narrow else propose(scope, head, k, inside)
        below, upto_low, below_high, upto_high = scope.agg(
            F.count_if(head < F.lit(low)),
            F.count_if(head <= F.lit(low)),
            F.count_if(head < F.lit(high)),
            F.count_if(head <= F.lit(high)),
        ).first()
        if k <= below:
            ceiling, inside = low, below
        elif k <= upto_low:
            return _ties(keys, cols, low, k - below, upto_low - below, sort_below)
        elif k <= below_high:
            floor, ceiling = low, high
            k, inside = k - upto_low, below_high - upto_low
        elif k <= upto_high:
            return _ties(keys, cols, high, k - below_high, upto_high - below_high, sort_below)
        else:
            floor = high
            k, inside = k - upto_high, inside - upto_high
        scope = keys
        if floor is not None:
            scope = scope.filter(head > F.lit(floor))
        if ceiling is not None:
            scope = scope.filter(head < F.lit(ceiling))
    return list(scope.sort(*cols).offset(k - 1).limit(1).first())


def _ties(scope, cols, value, k, inside, sort_below) -> list:
    """All rows left share the leading value: go on with the next order column."""
    if len(cols) == 1:
        return [value]
    rest = scope.filter(F.col(cols[0]) == F.lit(value)).select(*cols[1:])
    return [value, *_descend(rest, cols[1:], k, inside, sort_below)]


def at_or_before(df: DataFrame, order_by: Sequence[str], values: Sequence) -> Column:
    """Predicate: the row sorts at or before the given ordinals."""
    names = list(order_by)
    last = ordinal(df, names[-1])
    test = last <= F.lit(values[-1])
    for name, value in list(zip(names, values))[-2::-1]:
        col = ordinal(df, name)
        test = (col < F.lit(value)) | ((col == F.lit(value)) & test)
    return test
