"""Packing token sequences: exact complements first, best fit for the rest.

How pieces go together depends on their lengths alone, and there are at most
``capacity`` of them. So the plan is made from the counts by length, which is all
that reaches the driver, and comes back as intervals of ranks: "pieces of length
300 ranked 0 to 999 lie at offset 724 of sequences 5000 to 5999". Ranks within a
length are counted in salted groups, so a length that a third of all pieces share
is spread over many tasks. Token ids stay where they were made.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F, types as T
from tokenizers import Tokenizer

from ..session import materialise
from .batches import memo, slices, without

RANK_ROWS = 4_000
END = 2
PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class Vocabulary:
    """Ids of a byte-level tokenizer file.

    Where the file's merges run in the order of their ids, its vocabulary is a rank
    file and the faster reader of those gives the same ids; else the file's own library.
    With ``special`` the text of an added token is that token, as the library has it by
    default; without, it is ordinary text.
    """

    # Fixed value: the split of byte-level tokenizers, which the file names by "use_regex".
    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, special: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranked = None
        added = spec.get("added_tokens") or []
        if self._is_ranked(spec) and not (special and self._is_involved(added)):
            letters = self._letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
            self.ranked = tiktoken.Encoding("ranked", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added if special})
        else:
            self.own = Tokenizer.from_file(path)
            self.own.encode_special_tokens = not special

    @staticmethod
    def _is_involved(added: list[dict]) -> bool:
        """Whether added tokens take blanks with them, need word borders or begin with each other."""
        texts = [t["content"] for t in added]
        begins = any(a != b and a.startswith(b) for a in texts for b in texts)
        return begins or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))

    @staticmethod
    def _letters() -> dict[str, int]:
        """The printable character that stands for each byte in such files."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    @classmethod
    def _is_ranked(cls, spec: dict) -> bool:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("dropout") or model.get("byte_fallback"):
            return False
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b) for a, b in merges]
        single = all(c in model["vocab"] for c in cls._letters())
        return single and None not in made and all(a < b for a, b in zip(made, made[1:])) and not model.get("ignore_merges")

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranked is not None:
            return [self.ranked.encode_to_numpy(t, allowed_special="all", disallowed_special=()) for t in texts]
        return [np.array(e.ids, dtype=np.uint32) for e in self.own.encode_batch(texts, add_special_tokens=False)]


def cut(
    docs: DataFrame, path: str, capacity: int = 1024, column: str = "text", end: int = END, special: bool = False
) -> DataFrame:
    """Pieces of every whole text: ``piece, start, length, ids`` beside the other columns.

    A document is its ids and the end id, so an empty or null text is one piece of
    length 1. Documents over ``capacity`` are cut from the back into full pieces; the
    first one takes what is left. ``ids`` holds little-endian unsigned 32-bit integers.
    Columns named like the new ones are replaced; the text itself is dropped.
    """
    docs = without(docs, PIECE.names)
    kept = [c for c in docs.columns if c != column]

    def run(batches):
        vocabulary = memo(("vocabulary", path, special), lambda: Vocabulary(path, special))
        for batch in batches:
            for part in slices(batch, column):
                texts = pc.fill_null(part.column(column), "").to_pylist()
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for row, found in enumerate(vocabulary.encode_many(texts)):
                    whole = np.append(found, np.uint32(end)).astype("<u4")
                    first = (len(whole) - 1) % capacity + 1
                    edges = [0, *range(first, len(whole) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append(row)
                        pieces.append(n)
                        starts.append(a)
                        lengths.append(b - a)
                        ids.append(whole[a:b].tobytes())
                others = part.select(kept).take(pa.array(rows, pa.int32())).columns if kept else []
                new = [pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*others, *new], names=kept + PIECE.names)

    fields = [docs.schema[c] for c in kept]
    return docs.select(*kept, column).mapInArrow(run, T.StructType(fields + PIECE.fields))


class Sums:
    """What adds up to a total: single lengths, pairs and triples of the lengths that are there.

    Pairs are indexed by their sum when it is first asked for, the most even first, so that short
    pieces stay; a triple is a length and an indexed pair. Only lengths above ``floor`` take part in
    pairs and triples. An entry whose parts have run out is passed over.
    """

    def __init__(self, left: np.ndarray, floor: int):
        self.left, self.floor = left, floor
        self.index: dict[int, list[int]] = {}

    def single(self, total: int) -> bool:
        return self.left[total] > 0

    def pairs(self, total: int, most: int | None = None) -> Iterator[tuple[int, int]]:
        """Longer and shorter part, the longer one not above ``most``."""
        if total not in self.index:
            longer = np.arange((total + 1) // 2, total - self.floor)
            there = (self.left[longer] > 0) & (self.left[total - longer] > 0)
            self.index[total] = longer[there].tolist()
        for b in self.index[total]:
            if most is not None and b > most:
                return
            if self.left[b] and self.left[total - b]:
                yield b, total - b

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        for a in range((total + 2) // 3, total - 2 * self.floor):
            if self.left[a]:
                for b, c in self.pairs(total - a, a):
                    if not self.left[a]:
                        break
                    yield a, b, c


class Plan:
    """Which ranks of which lengths share sequences.

    ``counts[l]`` pieces of length ``l``. Gaps are filled exactly by one further piece, then by indexed
    pairs, then by triples, as often as all their parts are there; the rest goes by best fit. The shortest
    pieces, up to ``reserve`` of the whole size, stay out of pairs and triples: later gaps need them.
    """

    RESERVES = (0.0, 0.01, 0.02, 0.05)

    @classmethod
    def best(cls, counts: np.ndarray) -> Plan:
        """The plan of the fewest sequences among a few reserves and both directions of lengths."""
        least = -(-int(counts @ np.arange(len(counts))) // (len(counts) - 1))
        found = None
        for reserve in cls.RESERVES:
            for upwards in (False, True):
                plan = cls(counts, reserve, upwards)
                if found is None or plan.sequences < found.sequences:
                    found = plan
                if found.sequences == least:
                    return found
        return found

    def __init__(self, counts: np.ndarray, reserve: float = 0.0, upwards: bool = False):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros(len(counts), dtype=np.int64)
        self.sequences = 0
        #: sequences filled exactly by a piece and none, one, two or three more
        self.exact = [0, 0, 0, 0]
        #: (length, first rank, number, first sequence, offset)
        self.intervals: list[tuple[int, int, int, int, int]] = []
        sizes = np.cumsum(self.left * np.arange(len(counts)))
        self.floor = int(np.searchsorted(sizes, reserve * sizes[-1])) if reserve else 0
        self._complements(upwards)
        self._best_fit()

    def _emit(self, lengths: Sequence[int], number: int) -> None:
        offset = 0
        for length in lengths:
            self.intervals.append((length, int(self.used[length]), number, self.sequences, offset))
            self.used[length] += number
            offset += length
        self.sequences += number

    def _take(self, lengths: Sequence[int]) -> None:
        """Use a combination as often as the counts allow."""
        number = min(int(self.left[n]) // lengths.count(n) for n in set(lengths))
        if number:
            for n in lengths:
                self.left[n] -= number
            self._emit(lengths, number)
            self.exact[len(lengths) - 1] += number

    def _complements(self, upwards: bool) -> None:
        sums, every = Sums(self.left, self.floor), range(self.capacity, 0, -1)
        for length in every:
            if length == self.capacity:
                self._take([length])
            elif self.left[length] and sums.single(self.capacity - length):
                self._take([length, self.capacity - length])
        some = [n for n in (reversed(every) if upwards else every) if self.floor < n < self.capacity]
        for more in (sums.pairs, sums.triples):
            for length in some:
                if self.left[length]:
                    for parts in more(self.capacity - length):
                        self._take([length, *parts])
                        if not self.left[length]:
                            break

    def _best_fit(self) -> None:
        """What is left, longest first, each piece into the tightest gap that holds it."""
        open_bins: dict[int, list[list]] = {}  # by gap: [lengths, how many such sequences]
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                gap = min((g for g in open_bins if g >= length), default=None)
                if gap is None:
                    each = min(self.capacity // length, int(self.left[length]))
                    lengths, number = [length] * each, int(self.left[length]) // each
                else:
                    inside, there = open_bins[gap].pop()
                    number = min(there, int(self.left[length]))
                    if number < there:
                        open_bins[gap].append([inside, there - number])
                    if not open_bins[gap]:
                        del open_bins[gap]
                    each, lengths = 1, [*inside, length]
                self.left[length] -= number * each
                open_bins.setdefault(self.capacity - sum(lengths), []).append([lengths, number])
        for kinds in open_bins.values():
            for lengths, number in kinds:
                self._emit(lengths, number)


def place(pieces: DataFrame, capacity: int = 1024, order: Sequence[str] = ("doc_id", "piece"), rank_rows: int = RANK_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice (counts, then places) and must give the same rows both
    times: a written table. Rows that agree in everything are interchangeable. An empty
    table gives an empty result. Columns with the two names are replaced.
    """
    pieces = without(pieces, ["sequence_id", "offset", "_salt", "_rank", "_seen", "_pieces"])
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, number in pieces.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most capacity rows
        if length is None or not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit into {capacity}")
        counts[length] = number
    plan = Plan.best(counts)
    # groups of bounded size within a length, whatever its count; the whole row decides, as ids may be null or repeat
    groups = {n: int(-(-c // rank_rows)) for n, c in enumerate(counts.tolist()) if c > rank_rows}
    salts = F.lit(1)
    if groups:
        known = F.create_map(*[F.lit(v) for kv in groups.items() for v in kv])
        salts = F.coalesce(known[F.col("length").cast("int")], F.lit(1))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "length"]), salts).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_pieces"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("_pieces").over(before), F.lit(0)).alias("_seen"))
    inner = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(inner).cast("bigint") - 1).join(offsets, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_seen"))
    # The plan: one row per length with its intervals by first rank. Its size depends on the capacity only.
    by_length: dict[int, list] = {}
    for length, first, number, sequence, offset in plan.intervals:
        by_length.setdefault(length, []).append((first, sequence, offset))
    rows = [(n, *map(list, zip(*sorted(found)))) for n, found in by_length.items()]
    known = spark.createDataFrame(rows, "length bigint, _first array<bigint>, _sequence array<bigint>, _offset array<int>")
    joined = ranked.join(F.broadcast(known), "length")
    at = _last_not_above(F.col("_first"), F.col("_rank"))
    return joined.withColumn("_at", at).select(
        *pieces.columns,
        (F.element_at("_sequence", F.col("_at")) + F.col("_rank") - F.element_at("_first", F.col("_at"))).alias("sequence_id"),
        F.element_at("_offset", F.col("_at")).cast("bigint").alias("offset"),
    )


def _last_not_above(starts, value):
    """1-based position of the last of the sorted ``starts`` that is at most ``value``."""
    return F.aggregate(starts, F.lit(0), lambda n, x: n + F.when(x <= value, 1).otherwise(0))


def pack(
    docs: DataFrame, path: str, capacity: int = 1024, column: str = "text", order: str = "doc_id", digest=None, special: bool = False
) -> DataFrame:
    """Pieces of all documents with their places in as few sequences as the lengths allow.

    ``digest`` turns the pieces with their ids into what is to be kept of them; by
    default all columns and the ids stay. With ``special`` the texts of the file's added
    tokens are those tokens. The pieces are written to the shared folder,
    then placed.
    """
    pieces = cut(docs, path, capacity, column, special=special)
    return place(materialise(digest(pieces) if digest else pieces, "pieces"), capacity, (order, "piece"))
