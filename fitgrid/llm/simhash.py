"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one row, however many documents share it. Two fingerprints
that differ in at most ``radius`` bits agree on at least one of ``radius + 1``
blocks of bits, so only fingerprints with an equal block meet; each such group is
sorted by population count, cut into tiles and compared by exclusive-or and bit
counts, tile pair by tile pair, leaving out pairs whose population counts are
further apart than the radius. Nothing is approximate. A group over ``tile_rows`` is
split by population count, and further by a hash, so no task holds it whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise
from .batches import add_columns
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 512
CELL_ROWS = 16_384
HASHES = 1 << 16
# The characters that part words, and the letters that lose their case.
BLANK = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def hashes(text: str | None, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all shingles in their order, in bounded parts; a shorter text is one shingle."""
    words = BLANK.split((text or "").encode().translate(LOWER).strip(b" \t\n\v\f\r"))
    if words == [b""]:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    width = min(width, len(words))
    count = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, HASHES):
        upto = min(count, at + HASHES)
        first, last = starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], dtype=np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer."""
    bits, count = np.zeros(64, dtype=np.int64), 0
    for part in parts:
        octets = part.astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(2 * bits > count, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the hashes of all shingles, as a signed 64-bit integer."""
    return majority(hashes(text, width))


def fingerprints(docs: DataFrame, column: str = "text", out: str = "fingerprint", width: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of every whole text as ``bigint``.

    Words are parted by space and control blanks; shingles of ``width`` words count as
    often as they occur; a shorter text is one shingle; a null text or one without a word has
    fingerprint zero. A column named like ``out`` is replaced.
    """

    def kernel(texts):
        return [pa.array([fingerprint(t, width) for t in texts], pa.int64())]

    return add_columns(docs, column, kernel, T.StructType([T.StructField(out, T.LongType())]))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """``radius + 1`` blocks of the 64 bits, as (shift, width)."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, column: str = "fp", radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints within ``radius`` bits.

    Not every pair is listed: of the pairs found in one cell only a spanning forest
    leaves the task, so a dense group costs no more links than it has members.
    ``prints`` has distinct values.
    """
    blocks = [
        F.struct(F.lit(n).alias("no"), F.shiftrightunsigned(F.shiftleft(column, 64 - shift - width), 64 - width).alias("bits"))
        for n, (shift, width) in enumerate(_blocks(radius))
    ]
    rows = prints.select(F.col(column).alias("fp"), F.bit_count(column).alias("ones"), F.explode(F.array(*blocks)).alias("block"))
    rows = rows.select("fp", "ones", "block.no", "block.bits")
    sizes = rows.groupBy("no", "bits").agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.filter(F.col("n") > cell_rows)
    if crowded.isEmpty():
        cells = rows.select("fp", "ones", F.xxhash64("no", "bits").alias("cell"))
    else:
        cells = _cells(rows, crowded, radius, cell_rows)
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = cells.repartition(partitions, "cell").sortWithinPartitions("cell", "ones", "fp")
    return sorted_cells.mapInArrow(_compare(radius), "a bigint, b bigint").distinct()


def _cells(rows: DataFrame, crowded: DataFrame, radius: int, cell_rows: int) -> DataFrame:
    """Crowded groups by population count and hash; a cell holds one pair of such parts."""
    marked = rows.join(crowded.select("no", "bits", F.lit(True).alias("hot")), ["no", "bits"], "left")
    plain = marked.filter("hot is null").select("fp", "ones", F.xxhash64("no", "bits").alias("cell"))
    hot = marked.filter("hot")
    parts = hot.groupBy("no", "bits", "ones").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("parts"))
    placed = hot.join(parts, ["no", "bits", "ones"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # Every pair of parts within reach is one cell; it is named by its two members.
    by_group = parts.groupBy("no", "bits").agg(F.collect_list(F.struct("ones", "parts")).alias("others"))  # 65 at most
    near = F.filter("others", lambda o: F.abs(o["ones"] - F.col("ones")) <= radius)
    each = F.flatten(
        F.transform(near, lambda o: F.transform(F.sequence(F.lit(0), o["parts"] - 1), lambda p: F.struct(o["ones"].alias("ones"), p.alias("part"))))
    )
    meetings = placed.join(by_group, ["no", "bits"]).withColumn("other", F.explode(each))
    own = F.struct("ones", "part")
    cell = F.xxhash64("no", "bits", F.least(own, F.col("other")), F.greatest(own, F.col("other")))
    return plain.unionByName(meetings.select("fp", "ones", cell.alias("cell")))


def _compare(radius: int):
    """Compare the rows of each cell; cells lie one after the other in a partition."""

    def run(batches):
        cell, ones, fp = [], [], []
        for batch in batches:
            cell.append(batch.column("cell").to_numpy())
            ones.append(batch.column("ones").to_numpy())
            fp.append(batch.column("fp").to_numpy())
            c, o, f = np.concatenate(cell), np.concatenate(ones), np.concatenate(fp)
            whole = int(np.searchsorted(c, c[-1], side="left"))  # the last cell may go on
            if whole:
                yield _forest(c[:whole], o[:whole], f[:whole], radius)
            cell, ones, fp = [c[whole:]], [o[whole:]], [f[whole:]]
        if cell and len(cell[0]):
            yield _forest(cell[0], ones[0], fp[0], radius)

    return run


def _forest(cell: np.ndarray, ones: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """Spanning forest of the links among rows sorted by cell and population count."""
    values = fp.view(np.uint64)
    root = np.arange(len(fp))
    ends = np.searchsorted(cell, cell, side="right")
    for at in range(0, len(fp), TILE):
        upto = min(at + TILE, len(fp))
        last = int(ends[upto - 1])
        for other in range(at, last, TILE):
            stop = min(other + TILE, last)
            same = cell[upto - 1] == cell[other]
            if same and int(ones[other]) - int(ones[upto - 1]) > radius:
                break  # tiles further on have even more bits set
            far = np.bitwise_count(values[at:upto, None] ^ values[None, other:stop])
            i, j = np.nonzero(far <= radius)
            keep = i + at < j + other
            _join(root, i[keep] + at, j[keep] + other)
    hung = np.flatnonzero(fp != fp[root])
    return pa.RecordBatch.from_arrays([pa.array(fp[hung]), pa.array(fp[root[hung]])], names=["a", "b"])


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of each ``i`` and ``j``; a root is the least position of its tree."""
    while len(i):
        a, b = root[i], root[j]
        open_links = a != b
        i, j, a, b = i[open_links], j[open_links], a[open_links], b[open_links]
        if not len(i):
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", column: str = "text", radius: int = RADIUS, width: int = SHINGLE, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``key, fingerprint (bigint), group (bigint), component_id`` for every row of ``docs``.

    ``group`` is the least fingerprint reachable over links of at most ``radius`` bits,
    ``component_id`` the least key there. Null keys take part; a group without any key has a
    null ``component_id``. Repeated rows give repeated rows, an empty table an empty result.
    """
    slim = docs.select(F.col(key), F.col(column).alias("_text"))
    marked = materialise(fingerprints(slim, "_text", "_fp", width).drop("_text"), "fingerprints")
    distinct = materialise(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(key).alias("_least")), "distinct")
    roots = components(links(distinct.select("fp"), "fp", radius, cell_rows))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    known = known.select("fp", F.coalesce("root", "fp").alias("group"), "_least")
    names = known.groupBy("group").agg(F.min("_least").alias("component_id"))
    named = known.join(names, "group").select(F.col("fp").alias("_fp"), "group", "component_id")
    return marked.join(named, "_fp").select(key, F.col("_fp").alias("fingerprint"), "group", "component_id")


def keep_first(docs: DataFrame, find: Callable[[DataFrame, str, str], DataFrame], key: str, column: str) -> DataFrame:
    """The row of ``docs`` with the least key in each group; null keys last, then by the text's hash.

    ``find`` takes rows and the names of their key and text and gives ``component_id``, the least key of
    each row's group. A key alone may stand for several texts, so a row goes by key and text. Columns may have
    any name: they are set aside meanwhile.
    """
    held = docs.toDF(*[f"_column{i}" for i in range(len(docs.columns))])
    key, column = (held.columns[docs.columns.index(c)] for c in (key, column))
    place = F.struct(
        F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(column).alias("t"), F.xxhash64(F.lit(1), column).alias("u")
    )
    rows = held.withColumn("_row", place)
    found = find(rows, "_row", column)
    first = found.filter(F.col("_row") == F.col("component_id")).groupBy("_row").agg(F.count(F.lit(1)).alias("_rows"))
    first = materialise(first.select(*[F.col(f"_row.{c}").alias(f"_{c}") for c in ("none", "key", "t", "u")], "_rows"), "kept")

    def chosen(part: DataFrame) -> DataFrame:
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row.t") == F.col("_t")) & (F.col("_row.u") == F.col("_u"))
        return rows.join(part, same, "left_semi")

    kept = chosen(first.filter("_rows = 1")).select(*held.columns)
    if not first.filter("_rows > 1").isEmpty():
        whole = F.any_value(F.struct(*held.columns)).alias("_whole")
        kept = kept.unionByName(chosen(first.filter("_rows > 1")).groupBy("_row").agg(whole).select("_whole.*"))
    return kept.toDF(*docs.columns)


def one_per_group(
    docs: DataFrame, key: str = "doc_id", column: str = "text", radius: int = RADIUS, width: int = SHINGLE
) -> DataFrame:
    """The rows of ``docs`` that are left when one document of each group stays, by ``keep_first``."""
    return keep_first(docs, lambda rows, row, text: near_duplicates(rows, row, text, radius, width), key, column)
