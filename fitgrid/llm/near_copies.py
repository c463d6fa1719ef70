"""Near copies by SimHash, decided by the Jaccard similarity of their sets of word shingles.

Equal sets are one row, however many documents share it. SimHash fingerprints of the same shingles
find the near copies: sets with equal fingerprints, or fingerprints that ``simhash.links`` links,
are compared whole, and those that are similar enough are linked. Fingerprints of sets at the border of
the similarity differ in more bits than any radius for large tables allows, so what they leave apart is looked for
without them: sets are put in one order for all, rare shingles first; two sets that are similar
enough then share a shingle among the first ``n - ceil(similarity * n) + 1`` of each, so only sets
that meet there and are not linked yet are looked at, and only those that meet there often enough are
compared whole. No pair is lost. Crowded meetings are first compared with a few of their members; what
these connect is not compared again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise
from . import simhash
from .batches import add_columns
from .components import components

WIDTH = 5
SIMILARITY = (4, 5)  # as a fraction, so that the border is exact
CROWD = 64
LEADERS = 8
# The order of shingles only sets the cost: any order gives the same pairs.
ORDER_PART = 16
COMMON = 3
MAX_COMMON = 1 << 17


def _set(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *parts]).view(np.int64))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all shingles, signed; a shorter text is one shingle."""
    return _set(list(simhash.hashes(text, width)))


def _array(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, dtype=np.int64), *values])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _number(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a part of the texts, sorted, and the logarithm of their counts."""
    part = texts.filter(F.pmod("_t", F.lit(ORDER_PART)) == 0).select("_text")

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, width))], names=["s"])

    counts = part.mapInArrow(run, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "s").limit(MAX_COMMON).toArrow()
    values, n = top.column("s").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], np.log2(n[order]).astype(np.int8)


def _marked(texts: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray], similarity: tuple[int, int]) -> DataFrame:
    """Add the number ``_set`` of each text's set, its size ``_n``, the first shingles ``_head`` and the text's fingerprint ``_fp``."""
    values, levels = common
    up, down = similarity

    def head(found):
        n = len(found)
        if not n:
            return found
        if len(values):
            at = np.minimum(np.searchsorted(values, found), len(values) - 1)
            rank = np.where(values[at] == found, levels[at], 0)
            found = found[np.lexsort((found, rank))]
        return found[: n - (-(-up * n // down)) + 1]

    def kernel(texts):
        sets, prints = [], []
        for text in texts:
            parts = list(simhash.hashes(text, width))
            sets.append(_set(parts))
            prints.append(simhash.majority(parts))
        return [
            pa.array([_number(s) for s in sets], pa.int64()),
            pa.array([len(s) for s in sets], pa.int32()),
            _array([head(s) for s in sets]),
            pa.array(prints, pa.int64()),
        ]

    fields = [T.StructField("_set", T.LongType()), T.StructField("_n", T.IntegerType()), T.StructField("_head", T.ArrayType(T.LongType()))]
    return add_columns(texts, "_text", kernel, T.StructType([*fields, T.StructField("_fp", T.LongType())]))


def alike(sets: DataFrame, radius: int = simhash.RADIUS, cell_rows: int = simhash.CELL_ROWS) -> DataFrame:
    """Pairs ``id, n, id2, n2`` of the sets ``id, n, fp`` that SimHash puts together.

    Each set stands beside the least one of its fingerprint, and the least ones of two fingerprints beside
    each other where ``simhash.links`` links them.
    """
    first = F.min(F.struct("id", "n"))
    prints = materialise(sets.groupBy("fp").agg(first.alias("first")).select("fp", "first.*"), "prints")
    equal = sets.join(prints.toDF("fp", "id2", "n2"), "fp").filter("id <> id2").select("id", "n", "id2", "n2")
    linked = simhash.links(prints.select("fp"), "fp", radius, cell_rows)
    near = linked.join(prints.toDF("a", "id", "n"), "a").join(prints.toDF("b", "id2", "n2"), "b")
    return equal.unionByName(near.select("id", "n", "id2", "n2"))


def _confirm(pairs: DataFrame, texts: DataFrame, distinct: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs of sets ``a, b`` that are similar enough, compared whole."""
    up, down = similarity
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = distinct.join(wanted, "id", "left_semi").select("_t", "_u")
    chosen = texts.join(named, ["_t", "_u"], "left_semi").dropDuplicates(["_t", "_u"]).select("_text")

    def kernel(texts):
        sets = [shingles(t, width) for t in texts]
        return [pa.array([_number(s) for s in sets], pa.int64()), _array(sets)]

    fields = [T.StructField("id", T.LongType()), T.StructField("whole", T.ArrayType(T.LongType()))]
    sets = materialise(add_columns(chosen, "_text", kernel, T.StructType(fields)).drop("_text"), "sets")
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.filter((up + down) * both >= up * (F.size("x") + F.size("y"))).select("a", "b")


def _sized(met: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those ``n, n2`` whose sizes are near enough."""
    up, down = similarity
    return met.filter(down * F.least("n", "n2") >= up * F.greatest("n", "n2"))


def _meetings(cells: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``id, n, id2, n2``: sets of one cell whose sizes are near enough and that nothing connects yet, once for each cell."""
    right = cells.select("shingle", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("part").alias("part2"))
    return _sized(cells.join(right, "shingle").filter("part <> part2"), similarity)


def near_copies(
    docs: DataFrame,
    key: str = "doc_id",
    column: str = "text",
    width: int = WIDTH,
    similarity: tuple[int, int] = SIMILARITY,
    crowd: int = CROWD,
    radius: int = simhash.RADIUS,
    cell_rows: int = simhash.CELL_ROWS,
) -> DataFrame:
    """``key, group, component_id`` for every row of ``docs``.

    Texts whose sets of shingles of ``width`` words have a Jaccard similarity of at least
    ``similarity`` are linked, and groups are what links connect. Fingerprints within ``radius`` bits find
    pairs first; those that are further apart are found by their shingles. ``component_id`` is the least
    key of the group. Words are parted and compared as in ``simhash``; texts without a word
    are one group. Shingles and sets are told apart by 64-bit hashes.

    A null text has no word, like an empty or blank one; a text shorter than ``width`` words is one shingle, a very
    long one is read whole. Repeated rows are members like any other, and null keys too (a group of null keys
    only has a null ``component_id``). An empty table gives no rows; further columns are not read. The work
    is that of the pairs that share a shingle in their heads: texts that are made of the same few passages
    in ever new mixtures, none similar enough to another, meet in numbers that grow with their square.
    """
    up, down = similarity
    texts = docs.select(
        F.col(key).alias("_key"), F.col(column).alias("_text"), F.xxhash64(column).alias("_t"), F.xxhash64(F.lit(1), column).alias("_u")
    )
    marked = materialise(_marked(texts, width, _common(texts, width), similarity).drop("_text"), "marked")
    distinct = marked.groupBy(F.col("_set").alias("id")).agg(
        F.min(F.struct("_t", "_u")).alias("text"),
        F.any_value("_n").alias("n"),
        F.min("_key").alias("least"),
        F.any_value("_head").alias("head"),
        F.min("_fp").alias("fp"),
    )
    distinct = materialise(distinct.select("id", "text._t", "text._u", "n", "least", "head", "fp"), "distinct")
    met = _sized(alike(distinct.select("id", "n", "fp"), radius, cell_rows), similarity).select("id", "id2")
    rows = distinct.select("id", "n", F.explode("head").alias("shingle"))
    # counts and leaders by partial aggregates; a shingle of very many texts is a join that Spark splits
    sizes = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    cells = materialise(rows.join(sizes, "shingle"), "cells")
    crowded = cells.filter(F.col("m") > crowd)
    if not crowded.isEmpty():
        member = F.struct("id", "n")
        each = [F.min(F.when(F.pmod(F.xxhash64("id"), F.lit(LEADERS)) == i, member)) for i in range(LEADERS)]
        leaders = crowded.groupBy("shingle").agg(F.array_compact(F.array(*each)).alias("leaders"))
        beside = crowded.join(leaders, "shingle").withColumn("leader", F.explode("leaders"))
        beside = beside.select("id", "n", F.col("leader.id").alias("id2"), F.col("leader.n").alias("n2")).filter("id <> id2")
        met = met.unionByName(_sized(beside, similarity).select("id", "id2"))
    pairs = met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    links = materialise(_confirm(pairs, texts, distinct, width, similarity), "near")
    roots = components(links)
    cells = cells.join(roots, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("root", "id")).drop("node", "root")
    open_cells = cells.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("shingle")
    cells = materialise(cells.join(open_cells, "shingle", "left_semi"), "cells")
    met = _meetings(cells, similarity).filter("id < id2")
    met = met.groupBy(F.col("id").alias("a"), F.col("id2").alias("b")).agg(F.any_value("n").alias("na"), F.any_value("n2").alias("nb"), F.count(F.lit(1)).alias("c"))
    # of the set whose head ends first, all that is shared lies in both heads or behind its own
    behind = F.ceil(F.greatest("na", "nb") * F.lit(up) / F.lit(down)) - 1
    pairs = met.filter((up + down) * (F.col("c") + behind) >= up * (F.col("na") + F.col("nb"))).select("a", "b")
    found = _confirm(pairs, texts, distinct, width, similarity)
    roots = components(found.unionByName(links))
    known = distinct.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("group"), "least")
    names = known.groupBy("group").agg(F.min("least").alias("component_id"))
    named = known.join(names, "group").select(F.col("id").alias("_set"), "group", "component_id")
    return marked.join(named, "_set").select(F.col("_key").alias(key), "group", "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are left when one document of each group of near copies stays.

    The least key stays, null keys only where there is no other; of repeated rows one. All columns are kept, whatever
    their names; an empty table stays empty.
    """
    return simhash.keep_first(docs, lambda rows, row, text: near_copies(rows, row, text, **options), key, column)
