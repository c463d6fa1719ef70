"""Placing rows on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, given by an
offset and a step. The shards take turns, each claiming its next free slot, until
the table is full: all get the same number of slots, give or take one, and when a shard
comes or goes few slots change hands. A row's key hashes to a slot; the table, whose
size is a parameter, is broadcast, so placing costs one probe and no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .batches import without

SLOTS = 65_537
HEX_DIGITS = 15


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Number of the shard that owns each slot.

    Shard names must differ, and there may be as many as slots. The result does not depend on
    the order of the names, but for the numbers.
    """
    names = sorted(shards)
    if not names or len(set(names)) != len(names) or len(names) > slots or not is_prime(slots):
        raise ValueError("distinct shards, at most as many as a prime number of slots, are needed")
    number = {name: i for i, name in enumerate(shards)}
    place = [_hash(f"offset:{n}") % slots for n in names]
    step = [_hash(f"step:{n}") % (slots - 1) + 1 if slots > 2 else 1 for n in names]
    owner = np.full(slots, -1, dtype=np.int64)
    left = slots
    while left:
        for i, name in enumerate(names):
            at = place[i]
            while owner[at] >= 0:
                at = (at + step[i]) % slots
            owner[at] = number[name]
            place[i] = (at + step[i]) % slots
            left -= 1
            if not left:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text; a null key counts as empty text."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HEX_DIGITS)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(rows: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` (a name of ``shards``) to every row.

    Rows of one key share a shard; null keys share one, too. Columns named like the new ones are
    replaced. An empty table gives an empty result.
    """
    rows = without(rows, ["slot", "shard"])
    owner = lookup_table(shards, slots)
    known = rows.sparkSession.createDataFrame([(i, shards[o]) for i, o in enumerate(owner.tolist())], "slot int, shard string")
    return rows.withColumn("slot", slot(F.col(key), slots)).join(F.broadcast(known), "slot").select(*rows.columns, "slot", "shard")


def write(rows: DataFrame, path: str, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS, files: int = 4) -> None:
    """Write a folder per shard, each shard's rows in about ``files`` tasks' files.

    Rows are dealt by shard and a salt, so neither a large shard nor a frequent key lands in one task.
    """
    placed = place(rows, shards, key, slots)
    salted = placed.repartition(F.col("shard"), F.pmod(F.xxhash64(*placed.columns), F.lit(files)))
    salted.drop("slot").write.partitionBy("shard").parquet(path)


def moved(before: np.ndarray, after: np.ndarray, names_before: Sequence[str], names_after: Sequence[str]) -> float:
    """Share of the slots that change their shard between two tables."""
    return float(np.mean(np.array(names_before)[before] != np.array(names_after)[after]))
