"""Trie of the turns that conversations share from their beginning.

A turn is known by hashes of its place, role and text; the exclusive or of the hashes up to a place is
the digest of that prefix (two words of 64 bits), so digests of blocks can be combined in any grouping
and a giant conversation needs no chain of its own. Conversations are grouped by the digests of
successive blocks of ``BLOCK`` turns first. A block that all conversations of its prefix share is
taken from its least conversation alone; only where several different blocks follow the same prefix are
the members' turns looked at one by one.

A node belongs to its least member, so the nodes of one conversation are a run of depths that hangs on a
node of another one. Sums over subtrees are sums along such runs plus the totals of the runs that hang on
them; totals pass upwards by doubling pointers, in rounds that are logarithmic in the runs above each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.joins import lookup_join
from ..session import materialise
from .turns import GIANT_ROWS, numbered

BLOCK = 8
CHUNK = 4_096
OUT_ROWS = 4_096
ROOT = "0-0"
EMPTY_SHA = hashlib.sha256().hexdigest()


def slim_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", giant_rows: int = GIANT_ROWS
) -> DataFrame:
    """``conv, place, role, digest, size``: turns in order, each text as its MD5 and its number of code points.

    Null roles and texts are empty. Order: turn (null first), then role, then the text's MD5. Rows without an
    id belong to no conversation.
    """
    empty = F.lit("")
    found = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"),
        F.unhex(F.md5(F.coalesce(F.col(text), empty))).alias("digest"),
        F.length(F.coalesce(F.col(text), empty)).cast("bigint").alias("size"),
    )
    return numbered(found, "conv", "turn", ["role", "digest"], "place", giant_rows).drop("turn")


def _scan(
    df: DataFrame, key: str, place: str, columns: dict[str, str], merge: Callable, join: Callable, chunk: int, backwards: bool = False
) -> DataFrame:
    """Running totals of columns within a key, by chunks of places, so that no task orders a whole large key."""
    part = F.floor(F.col(place) / chunk)
    order = F.desc(place) if backwards else F.asc(place)
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunked = df.withColumn("_chunk", part)
    totals = chunked.groupBy(key, "_chunk").agg(*[merge(c).alias(f"_{out}") for out, c in columns.items()])
    ahead = F.desc("_chunk") if backwards else F.asc("_chunk")
    others = Window.partitionBy(key).orderBy(ahead).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_chunk", *[merge(f"_{out}").over(others).alias(f"_{out}") for out in columns])
    before = before.filter(F.col(f"_{next(iter(columns))}").isNotNull())
    scanned = chunked.withColumns({out: merge(c).over(inside) for out, c in columns.items()}).join(before, [key, "_chunk"], "left")
    done = {out: F.when(F.col(f"_{out}").isNull(), F.col(out)).otherwise(join(F.col(out), F.col(f"_{out}"))) for out in columns}
    return scanned.withColumns(done).drop("_chunk", *[f"_{out}" for out in columns])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _key(a: Column | str, b: Column | str) -> Column:
    return F.concat(F.hex(a), F.lit("-"), F.hex(b))


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending, with commas; ids come in pieces of bounded length."""
    pieces = (
        ends.groupBy("key", F.floor(F.col("conv") / CHUNK).alias("piece"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
        .repartition("key")
        .sortWithinPartitions("key", "piece")
        .select("key", "ids")
    )

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["key", "ends_sha256"])

    def run(batches):
        at, found, out = None, None, []
        for batch in batches:
            for key, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "ids"))):
                if key != at:
                    if at is not None:
                        out.append((at, found.hexdigest()))
                    at, found = key, hashlib.sha256()
                else:
                    found.update(b",")
                found.update(ids.encode())
            if len(out) >= OUT_ROWS:
                yield pack(out)
                out = []
        if at is not None:
            yield pack([*out, (at, found.hexdigest())])

    return pieces.mapInArrow(run, "key string, ends_sha256 string")


def _totals(runs: DataFrame) -> DataFrame:
    """``conv, leaves, saved`` of every run with all runs that hang on it, from ``conv, up, leaves, saved``."""
    now = materialise(runs, "runs")
    while now.filter(F.col("up").isNotNull()).take(1):
        hanging = now.filter(F.col("up").isNotNull())
        add = hanging.groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        further = lookup_join(hanging.select("conv", "up"), now.select(F.col("conv").alias("up"), F.col("up").alias("next")), "up")
        moved = further.filter(F.col("next").isNotNull()).select("conv", F.col("next").alias("up"))
        now = materialise(
            now.drop("up")
            .join(add, "conv", "left")
            .join(moved, "conv", "left")
            .select(
                "conv",
                "up",
                (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"),
            ),
            "runs",
        )
    return now.drop("up")


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct prefix of the conversations in ``ids`` (one column), the empty prefix included.

    ``turns`` are ``conv, place, role, digest, size`` with places 1, 2, … in every conversation; a conversation
    without turns is a member of the root only. A row has ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree, and
    ``ends_sha256`` of the members that end there. Conversations that are equal share all their nodes. No ids, no rows.
    """
    ids = ids.toDF("conv")
    lanes = {f"z{i}": F.xxhash64(F.lit(10 + i), "place", "role", "digest") for i in (1, 2)}
    rows = turns.select("conv", "place", "size", *[z.alias(n) for n, z in lanes.items()])
    rows = materialise(rows.withColumn("block", F.floor((F.col("place") - 1) / block)), "turns")
    blocks = rows.groupBy("conv", "block").agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
    blocks = _scan(blocks, "conv", "block", {"x1": "b1", "x2": "b2"}, F.bit_xor, _xor, chunk)
    prior = [_xor(F.col(f"x{i}"), F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)]
    blocks = blocks.select("conv", "block", _key("x1", "x2").alias("after"), *prior)
    blocks = materialise(blocks.withColumn("before", _key("p1", "p2")), "blocks")

    groups = blocks.groupBy("before", "after").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("conv", "block", "p1", "p2")).alias("first"))
    variants = groups.groupBy("before").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.min("members").alias("members"))
    variants = materialise(variants, "variants")
    shared = variants.filter("n = 1").select("first.*", "members")
    divided = lookup_join(blocks, variants.filter("n > 1").select("before"), "before", "left_semi")
    chosen = shared.unionByName(divided.select("conv", "block", "p1", "p2", F.lit(1).cast("bigint").alias("members")))
    inside = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = {f"d{i}": _xor(F.bit_xor(f"z{i}").over(inside), F.col(f"p{i}")) for i in (1, 2)}
    met = rows.join(chosen, ["conv", "block"]).withColumns(reached)
    parent = [_xor(F.col(f"d{i}"), F.col(f"z{i}")) for i in (1, 2)]
    met = met.select(_key("d1", "d2").alias("key"), _key(*parent).alias("parent"), F.col("place").alias("depth"), "conv", "members", "size")
    nodes = met.groupBy("key", "depth").agg(
        F.min("parent").alias("parent"), F.min("conv").alias("conv"), F.sum("members").alias("n_convs"), F.max("size").alias("size")
    )
    root = ids.agg(F.min("conv").alias("conv"), F.count("conv").alias("n_convs")).filter("n_convs > 0")
    top = [F.lit(ROOT).alias("key"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("parent")]
    nodes = nodes.unionByName(root.select(*top, "conv", "n_convs", F.lit(0).cast("bigint").alias("size")))
    nodes = materialise(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "nodes")

    runs = nodes.groupBy("conv").agg(
        F.min("depth").alias("first"), F.max("depth").alias("last"), F.min_by("parent", "depth").alias("parent"), F.sum("saved").alias("saved")
    )
    owners = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("up"))
    hung = lookup_join(runs.filter(F.col("parent").isNotNull()), owners, "parent")
    top_run = runs.filter(F.col("parent").isNull()).withColumn("up", F.lit(None).cast("bigint"))
    runs = hung.unionByName(top_run, allowMissingColumns=True).drop("parent")
    runs = materialise(runs, "runs")
    places = runs.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv"), (F.col("first") - 1).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    leaf = runs.join(places, ["conv", "last"], "left").withColumn("leaves", F.when(F.col("n").isNull(), 1).otherwise(0).cast("bigint"))
    totals = _totals(leaf.select("conv", "up", "leaves", "saved"))

    # what is known about single nodes of a run: where it begins and ends, and what hangs there
    nothing = {c: F.lit(None).cast("bigint") for c in ("up", "last", "children", "leaves", "more")}
    hanging = runs.filter(F.col("up").isNotNull()).join(totals.withColumnRenamed("saved", "more"), "conv").select(F.col("up").alias("conv"), (F.col("first") - 1).alias("depth"), "leaves", "more")
    hanging = hanging.groupBy("conv", "depth").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("more").alias("more"))
    marks = (
        runs.select("conv", F.col("first").alias("depth"), "up")
        .unionByName(runs.select("conv", F.col("last").alias("depth"), F.lit(1).cast("bigint").alias("last")), allowMissingColumns=True)
        .unionByName(hanging, allowMissingColumns=True)
        .groupBy("conv", "depth")
        .agg(*[F.max(c).alias(c) for c in nothing], F.max(F.when(F.col("up").isNotNull(), 1)).alias("begins"))
    )
    known = nodes.join(marks, ["conv", "depth"], "left")
    children = F.coalesce("children", F.lit(0)) + F.when(F.col("last").isNull(), 1).otherwise(0)
    known = known.select(
        "conv",
        "depth",
        "key",
        "n_convs",
        children.alias("n_children"),
        F.when(F.col("depth") == 0, None).when(F.col("begins") == 1, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"),
        (F.coalesce("leaves", F.lit(0)) + F.when(children == 0, 1).otherwise(0)).alias("here"),
        (F.col("saved") + F.coalesce("more", F.lit(0))).alias("own"),
    )
    summed = _scan(known, "conv", "depth", {"n_leaves": "here", "saved_tokens": "own"}, F.sum, lambda a, b: a + b, chunk, backwards=True)

    last = rows.groupBy("conv").agg(_key(F.bit_xor("z1"), F.bit_xor("z2")).alias("key"))
    ends = ids.join(last, "conv", "left").select("conv", F.coalesce("key", F.lit(ROOT)).alias("key"))
    out = summed.join(_end_digests(ends), "key", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
