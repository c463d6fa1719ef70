"""Train/test splits of exact size that do not sort the table.

The border between the parts is one row: its order values are found by
selection over the order columns alone, and the split itself is a comparison
with literals. No shuffle, and the same rows on every run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..plans.selection import SORT_BELOW, at_or_before, kth_row, ordinal

HASH_DIGITS = 15
HASH_SPACE = 16**HASH_DIGITS
ROUNDS = 8


def counted(df: DataFrame, names: Sequence[str]) -> int:
    """Number of rows; an error if one of the named columns is null anywhere."""
    missing = F.exists(F.array(*[F.col(n).isNull() for n in names]), lambda m: m)
    rows, nulls = df.agg(F.count(F.lit(1)), F.count_if(missing)).first()
    if nulls:
        raise ValueError(f"{nulls} rows have a null in {list(names)}")
    return rows


def ordered_split(
    df: DataFrame,
    order_by: Sequence[str],
    ratio: float = 0.8,
    rounding: str = "floor",
    sort_below: int = SORT_BELOW,
) -> DataFrame:
    """First ``floor`` or ``ceil`` of ``ratio * n`` rows in ``order_by`` are ``train``.

    Rows without a place in the order are refused.
    """
    rows = counted(df, order_by)
    size = {"floor": math.floor, "ceil": math.ceil}[rounding](ratio * rows)
    if size == 0:
        return df.withColumn("part", F.lit("test"))
    border = kth_row(df, order_by, size, rows, sort_below)
    inside = at_or_before(df, order_by, border)
    return df.withColumn("part", F.when(inside, F.lit("train")).otherwise(F.lit("test")))


def hash_position(key: Sequence[str], seed: int) -> Column:
    """The first 60 bits of ``md5(seed:key)`` in hexadecimal: text that orders like a number."""
    text = F.lit(f"{seed}:")
    for i, k in enumerate(key):
        text = F.concat(text, *([F.lit(":")] if i else []), F.col(k).cast("string"))
    return F.substring(F.md5(text), 1, HASH_DIGITS)


def _hex(place: float) -> str:
    return f"{min(max(int(place), 0), HASH_SPACE - 1):0{HASH_DIGITS}x}"


def _narrow(floor: str | None, ceiling: str | None, k: int, inside: int) -> tuple[str, str]:
    """Hashes are uniform, so six deviations around the expected place hold the row."""
    low = int(floor, 16) if floor else 0
    high = int(ceiling, 16) if ceiling else HASH_SPACE
    share = k / inside
    spread = min(0.2, 6.0 * math.sqrt(share * (1.0 - share) / inside) + 1.0 / inside)
    return _hex(low + (high - low) * (share - spread)), _hex(low + (high - low) * (share + spread))


def random_split(
    df: DataFrame,
    key: str | Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    exact: bool = True,
    sort_below: int = SORT_BELOW,
) -> DataFrame:
    """``ceil(test_size * n)`` rows with the lowest hash of their key are ``test``.

    The key has to be unique and without nulls. With ``exact=False`` the border is the share of
    the hash space instead of a counted row: one pass, size only nearly exact.
    """
    key = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_hash", hash_position(key, seed))
    if exact:
        rows = counted(df, key)
        size = math.ceil(test_size * rows)
        if size == 0:
            return df.withColumn("part", F.lit("train"))
        order = ["_hash", *key]
        border = kth_row(hashed, order, size, rows, sort_below, _narrow)
        chosen = at_or_before(hashed, order, border)
    else:
        chosen = F.col("_hash") < F.lit(_hex(test_size * HASH_SPACE))
    return hashed.withColumn("part", F.when(chosen, F.lit("test")).otherwise(F.lit("train"))).drop("_hash")


def random_tests(
    df: DataFrame, key: str | Sequence[str], test_size: float, seeds: Sequence[int], rows: int | None = None, sort_below: int = SORT_BELOW
) -> DataFrame:
    """Add ``_test0``, ``_test1``, …: whether ``random_split`` by the first, second, … seed has a row in ``test``.

    All seeds narrow their intervals in the same passes, so their number does not change how often
    the keys are read.
    """
    key = [key] if isinstance(key, str) else list(key)
    rows = counted(df, key) if rows is None else rows
    size = math.ceil(test_size * rows)
    if size == 0:
        return df.withColumns({f"_test{i}": F.lit(False) for i in range(len(seeds))})
    hashed = df.select(*key, *[hash_position(key, seed).alias(f"_h{i}") for i, seed in enumerate(seeds)])
    # wanted place, first and last hash that can have it, rows from the first to the last
    state = [[size, 0, HASH_SPACE - 1, rows] for _ in seeds]
    for _ in range(ROUNDS):  # few are enough for unique keys; what is left then is sorted whole
        if all(s[3] <= sort_below for s in state):
            break
        asked = {}
        for i, (k, low, high, inside) in enumerate(state):
            if inside > sort_below:
                near = _narrow(_hex(low) if low else None, _hex(high), k, inside)
                asked[i] = max(near[0], _hex(low)), min(near[1], _hex(high))
        tests = [F.count_if((F.col(f"_h{i}") >= _hex(state[i][1])) & t) for i, (low, high) in asked.items() for t in (F.col(f"_h{i}") < low, F.col(f"_h{i}") <= high)]
        found = hashed.agg(*tests).first()
        for n, (i, (low, high)) in enumerate(asked.items()):
            k, first, last, inside = state[i]
            below, upto = found[2 * n], found[2 * n + 1]
            if k <= below:
                state[i] = [k, first, int(low, 16) - 1, below]
            elif k <= upto:
                state[i] = [k - below, int(low, 16), int(high, 16), upto - below]
            else:
                state[i] = [k - upto, int(high, 16) + 1, last, inside - upto]
    order = ["_hash", *key]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_h{i}").alias("_hash")) for i in range(len(seeds))])
    open_ = F.array(*[F.struct(F.lit(_hex(s[1])).alias("low"), F.lit(_hex(s[2])).alias("high")) for s in state])
    wide = hashed.select(*key, F.explode(each).alias("s")).select(*key, "s.i", "s._hash").withColumn("_o", F.get(open_, F.col("i")))
    inside = wide.filter((F.col("_hash") >= F.col("_o.low")) & (F.col("_hash") <= F.col("_o.high")))
    place = F.row_number().over(Window.partitionBy("i").orderBy(*order))
    wanted = F.get(F.array(*[F.lit(s[0]) for s in state]), F.col("i"))
    borders = {r["i"]: r for r in inside.withColumn("_place", place).filter(F.col("_place") == wanted).collect()}
    out = df
    for i, seed in enumerate(seeds):
        here = out.withColumn("_hash", hash_position(key, seed))
        border = [borders[i]["_hash"], *[_literal(df, k, borders[i][k]) for k in key]]
        out = here.withColumn(f"_test{i}", at_or_before(here, order, border)).drop("_hash")
    return out


def _literal(df: DataFrame, name: str, value):
    """The number that ``ordinal`` gives for a value of a column."""
    row = df.sparkSession.createDataFrame([(value,)], T.StructType([df.schema[name]]))
    return row.select(ordinal(row, name)).first()[0]
