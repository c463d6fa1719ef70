"""Byte-level BPE with a segment tree of pair ranks.

A pre-token's bytes are the leaves of a segment tree. A live leaf holds the rank
of the pair that starts there (infinity if it cannot merge), an inner node the
least of its children, so the root names the leftmost pair of least rank. A merge
changes three leaves (itself, its live neighbour to the left, the swallowed one)
and walks up from them: O(n log n) for any pre-token. The trees of many
pre-tokens of one size advance together as the rows of numpy matrices, and each
worker keeps what it has encoded, since words repeat.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, types as T

from .batches import add_columns, memo

NONE = np.iinfo(np.int64).max
CACHE_WORDS = 250_000
BLOCK_WORDS = 100_000
TREE_LEAVES = 1 << 18
LONG_TEXT = 1 << 20


class NewerLetters(Exception):
    """The words hold characters whose class the two Unicode versions see differently."""


def newer_letters(kind: str) -> str:
    """Ranges of the characters that ``regex`` counts as ``kind`` and tiktoken's older Unicode does not."""
    chars = regex.findall(kind, "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    classes = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    known = set(classes.decode(classes.encode_ordinary("".join(chars))))
    points = np.array([ord(c) for c in chars if c not in known], dtype=np.int64)
    if not len(points):
        return ""
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


class Ranks:
    """A rank file: bytes of every token, and the rank of every pair of tokens that merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        letters, numbers = newer_letters(r"\p{L}"), newer_letters(r"\p{N}")
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]") if letters else pattern
        older = older.replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]") if numbers else older
        self.pattern, self.older = regex.compile(pattern), regex.compile(older, regex.V1)
        self.newer = regex.compile(f"[{letters}{numbers}]" if letters or numbers else r"(?!)")
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.bytes[rank] = token
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Ranks:
        return memo(("ranks", path, pattern), lambda: cls(path, pattern))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def words(self, text: str, pattern) -> Iterator[list[str]]:
        """The pattern's matches, in lists of bounded length."""
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
            return
        block = []
        for match in pattern.finditer(text):
            block.append(match.group())
            if len(block) >= BLOCK_WORDS:
                yield block
                block = []
        yield block

    def encode_words(self, words: list[str], older: bool) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        young, old = self.young, self.old
        fresh = []
        for w in set(words):
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    fresh.append(w)
        found = young
        if fresh:
            ids = zip(fresh, merge_all(self, [w.encode() for w in fresh]))
            if not self.newer.search("".join(fresh)):
                young.update(ids)
            elif older:
                found = young | dict(ids)  # such words are not kept: they must be noticed each time
            else:
                raise NewerLetters
        found = list(map(found.__getitem__, words))
        if len(young) > CACHE_WORDS:  # what has not been met since the last turn is forgotten
            self.old, self.young = young, {}
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of one text of any length."""
        for older, pattern in ((False, self.pattern), (True, self.older)):
            try:
                return b"".join(b"".join(self.encode_words(words, older)) for words in self.words(text or "", pattern))
            except NewerLetters:
                pass
        raise AssertionError("the older classes accept every text")

    def encode_many(self, texts: list) -> list[bytes]:
        """As ``encode``, with the new words of all short texts merged together."""
        short = [self.pattern.findall(t) if t and len(t) <= LONG_TEXT else [] for t in texts]
        try:
            flat = self.encode_words([w for words in short for w in words], False)
        except NewerLetters:
            return [self.encode(t) for t in texts]
        out, at = [], 0
        for text, words in zip(texts, short):
            if text and len(text) > LONG_TEXT:
                out.append(self.encode(text))
            else:
                out.append(b"".join(flat[at : at + len(words)]))
            at += len(words)
        return out

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


def merge_all(ranks: Ranks, words: list[bytes]) -> list[bytes]:
    """Encode words; trees of one size run together, in blocks of bounded memory."""
    out = [b""] * len(words)
    sizes: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        whole = ranks.ids.get(word)
        if whole is not None:
            out[i] = np.uint32(whole).astype("<u4").tobytes()
        elif word:
            sizes.setdefault(max(1, (len(word) - 1).bit_length()), []).append(i)
    for height, members in sizes.items():
        step = max(1, TREE_LEAVES >> height)
        for at in range(0, len(members), step):
            block = members[at : at + step]
            for i, ids in zip(block, _merge_block(ranks, [words[i] for i in block], height)):
                out[i] = ids
    return out


def _merge_block(ranks: Ranks, words: list[bytes], height: int) -> list[bytes]:
    leaves, n = 1 << height, len(words)
    raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), dtype=np.uint8).reshape(n, leaves)
    length = np.array([len(w) for w in words])
    place = np.arange(leaves)
    live = place < length[:, None]
    token = np.full((n, leaves + 1), -1, dtype=np.int64)  # the last column stands for "no neighbour"
    token[:, :leaves] = np.where(live, ranks.single[raw], -1)
    after = np.broadcast_to(np.minimum(place + 1, leaves), (n, leaves)).copy()
    after[np.arange(n), length - 1] = leaves
    before = np.full((n, leaves + 1), leaves, dtype=np.int64)
    before[:, 1:leaves] = place[:-1]
    tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
    row, col = np.nonzero(live & (place + 1 < length[:, None]))
    rank = ranks.pair(token[row, col], token[row, col + 1])
    can = rank != NONE
    tree[row[can], leaves + col[can]] = (rank[can] << height) | col[can]
    for level in range(height - 1, -1, -1):
        low, high = 1 << level, 2 << level
        np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2], out=tree[:, low:high])
    active = np.flatnonzero(tree[:, 1] != NONE)
    while len(active):
        root = tree[active, 1]
        here, merged = root & (leaves - 1), root >> height
        gone = after[active, here]
        right, left = after[active, gone], before[active, here]
        token[active, here] = merged
        token[active, gone] = -1
        after[active, here] = right
        before[active, right] = here
        tree[active, leaves + gone] = NONE
        _set_pair(ranks, tree, token, active, here, right, height)
        has_left = np.flatnonzero(left < leaves)
        _set_pair(ranks, tree, token, active[has_left], left[has_left], here[has_left], height)
        rows = np.concatenate([active, active, active[has_left]])
        node = np.concatenate([here, gone, left[has_left]]) + leaves
        for _ in range(height):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        active = active[tree[active, 1] != NONE]
    kept = token[:, :leaves] >= 0
    ids = token[:, :leaves][kept].astype("<u4").tobytes()
    ends = np.cumsum(kept.sum(axis=1)) * 4
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _set_pair(ranks, tree, token, rows, at, right, height) -> None:
    """Leaf of the pair that starts at ``at``; no pair where nothing follows."""
    leaves = 1 << height
    rank = ranks.pair(token[rows, at], np.maximum(token[rows, right], 0))
    none = (rank == NONE) | (right == leaves)
    tree[rows, leaves + at] = np.where(none, NONE, (np.where(none, 0, rank) << height) | at)


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids; special tokens are ordinary text.
    Rows keep their number and every other column; a column named like ``out`` is
    replaced. ``path`` must be readable on the executors.
    """

    def kernel(texts):
        return [pa.array(Ranks.of(path, pattern).encode_many(texts), pa.binary())]

    return add_columns(df, column, kernel, T.StructType([T.StructField(out, T.BinaryType())]))


def decode(df: DataFrame, path: str, pattern: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for; null ids give no bytes, unknown ids an error."""

    def kernel(rows):
        ranks = Ranks.of(path, pattern)
        return [pa.array([ranks.decode(ids) for ids in rows], pa.binary())]

    return add_columns(df, column, kernel, T.StructType([T.StructField(out, T.BinaryType())]))
