"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens. Its leaves are runs of consecutive
pre-tokens; a node holds the characters and tokens below it. An edit descends by
characters to the leaves it touches. Pre-tokens are split again from the last boundary
that the edit cannot reach, over the edited text, until a boundary meets one of the old text behind the edit:
from there on the split goes as before. Only these words are encoded, and the sums on the path
to the root are put right. The pattern looks ahead two characters at most, which is the
context kept in front of an edit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .batches import add_columns, slices, without
from .bpe import LONG_TEXT, NewerLetters, Ranks

LEAF_WORDS = 64
LOOKAHEAD = 2
AHEAD_WORDS = 8
PRIVATE = re.compile(r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)|\+?\d(?:[\d() -]{5,}\d)")
EDIT = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("insert", T.StringType())])
)
COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_tokens_before", "n_tokens", "n_words", "n_reencoded")])


class TokenTree:
    """Pre-tokens of one text with the sums of their characters and tokens."""

    def __init__(self, text: str, ranks: Ranks, words: list[str] | None = None):
        self.ranks, self.older = ranks, False
        try:
            if words is None:
                words = [w for block in ranks.words(text, ranks.pattern) for w in block]
            tokens = self._tokens(words)
        except NewerLetters:
            self.older = True
            words = [w for block in ranks.words(text, ranks.older) for w in block]
            tokens = self._tokens(words)
        self.leaves = [(words[i : i + LEAF_WORDS], tokens[i : i + LEAF_WORDS]) for i in range(0, len(words), LEAF_WORDS)] or [([], [])]
        self.reencoded = 0
        self._grow()

    def _tokens(self, words: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in self.ranks.encode_words(words, self.older)]

    def _grow(self) -> None:
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars = np.zeros(2 * self.size, dtype=np.int64)
        self.tokens = np.zeros(2 * self.size, dtype=np.int64)
        for i, (words, tokens) in enumerate(self.leaves):
            self.chars[self.size + i] = sum(map(len, words))
            self.tokens[self.size + i] = sum(tokens)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, leaf: int, words: list[str], tokens: list[int]) -> None:
        self.leaves[leaf] = (words, tokens)
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, words)), sum(tokens)
        while node > 1:
            node //= 2
            self._sum(node)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(w for words, _ in self.leaves for w in words)

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char - before >= self.chars[node] and self.chars[node + 1] > 0:
                before += int(self.chars[node])
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before

    def _words_from(self, leaf: int, at: int):
        """(leaf, place in it, word) in order."""
        while leaf < len(self.leaves):
            words = self.leaves[leaf][0]
            for i in range(at, len(words)):
                yield leaf, i, words[i]
            leaf, at = leaf + 1, 0

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start``; both are held inside the text."""
        start = min(max(start, 0), self.length)
        length = min(max(length, 0), self.length - start)
        if not length and not insert:
            return
        if self.ranks.newer.search(insert) and not self.older:
            self._restart(start, length, insert)
            return
        # the first word that ends less than the lookahead before the edit
        leaf, at = self._find(max(0, start - LOOKAHEAD))
        place = 0
        words = self.leaves[leaf][0]
        while place < len(words) and at + len(words[place]) + LOOKAHEAD <= start:
            at += len(words[place])
            place += 1
        ahead = self._words_from(leaf, place)
        pattern = self.ranks.older if self.older else self.ranks.pattern
        stop = start + length  # the edit's end in the old text
        taken, ends = [], []  # old words from here on, and where each ends in the old text
        reach, done = at, False
        want = stop + LOOKAHEAD
        while True:
            more = AHEAD_WORDS
            while not done and (reach < want or more > 0):
                found = next(ahead, None)
                if found is None:
                    done = True
                    break
                taken.append(found)
                reach += len(found[2])
                ends.append(reach)
                more -= reach >= want
            old = "".join(w for _, _, w in taken)
            fresh = old[: start - at] + insert + old[stop - at :]
            shift = len(insert) - length
            bounds = {e + shift: i for i, e in enumerate(ends) if e >= stop}
            split, position, met = [], at, None
            for match in pattern.finditer(fresh):
                end = at + match.end()
                if not done and end + LOOKAHEAD > at + len(fresh):
                    break  # what follows is not here yet
                split.append(match.group())
                position = end
                if position >= start + len(insert) and position in bounds:
                    met = bounds[position]
                    break
            if met is not None or (done and position == at + len(fresh)):
                break
            want = reach + 1 + len(fresh)
        number = len(taken) if met is None else met + 1
        self.reencoded += len(split)
        self._replace(leaf, place, taken[:number], split)

    def _replace(self, leaf: int, place: int, gone: list, split: list[str]) -> None:
        """Put the new words where the old ones were; they all go into the first leaf."""
        tokens = self._tokens(split)
        last = gone[-1][0] if gone else leaf
        for other in range(leaf + 1, last + 1):
            cut = sum(1 for g in gone if g[0] == other)
            words, counts = self.leaves[other]
            self._set(other, words[cut:], counts[cut:])
        cut = sum(1 for g in gone if g[0] == leaf)
        words, counts = self.leaves[leaf]
        self._set(leaf, words[:place] + split + words[place + cut :], counts[:place] + tokens + counts[place + cut :])
        if len(self.leaves[leaf][0]) > 4 * LEAF_WORDS:
            words = [w for ws, _ in self.leaves for w in ws]
            counts = [c for _, cs in self.leaves for c in cs]
            self.leaves = [(words[i : i + LEAF_WORDS], counts[i : i + LEAF_WORDS]) for i in range(0, len(words), LEAF_WORDS)]
            self._grow()

    def _restart(self, start: int, length: int, insert: str) -> None:
        """The inserted text needs the older letter classes, which may split all other words anew."""
        old = self.text()
        again = TokenTree(old[:start] + insert + old[start + length :], self.ranks)
        again.reencoded = self.reencoded + sum(len(words) for words, _ in again.leaves)
        self.__dict__ = again.__dict__


def _split_all(texts: list[str], ranks: Ranks) -> list:
    """Words of the short texts, their new ones encoded together; None where a tree splits for itself."""
    split = [ranks.pattern.findall(t) if len(t) <= LONG_TEXT else None for t in texts]
    try:
        ranks.encode_words([w for words in split if words for w in words], False)
    except NewerLetters:
        return [None] * len(texts)
    return split


def masking_edits(docs: DataFrame, column: str = "text", out: str = "edits") -> DataFrame:
    """Add the edits that put a mark in place of mail addresses and long numbers, last one first."""

    def kernel(texts):
        found = []
        for text in texts:
            spans = [] if text is None else [(m.start(), m.end() - m.start(), "[mail]" if m.group(1) else "[number]") for m in PRIVATE.finditer(text)]
            found.append([{"start": a, "length": n, "insert": mark} for a, n, mark in reversed(spans)])
        return [pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("insert", pa.string())])))]

    return add_columns(docs, column, kernel, T.StructType([T.StructField(out, EDIT)]))


def count_edits(docs: DataFrame, path: str, pattern: str, column: str = "text", edits: str = "edits") -> DataFrame:
    """Add token counts before and after the edits of every whole text.

    ``edits`` is ``array<struct<start:int, length:int, insert:string>>``, applied in order, each
    to the text that the ones before it left; positions are characters from 0 and are held inside
    the text. ``n_words`` counts pre-tokens at the end, ``n_reencoded`` those that edits had encoded
    again. A null text counts as empty, null edits as none, a null insert as empty. The text itself
    is dropped; columns named like the new ones are replaced.
    """
    docs = without(docs, COUNTS.names)
    kept = [c for c in docs.columns if c not in (column, edits)]

    def run(batches):
        for batch in batches:
            ranks = Ranks.of(path, pattern)
            for part in slices(batch, column):
                rows = []
                texts = [t or "" for t in part.column(column).to_pylist()]
                split = _split_all(texts, ranks)
                for text, words, changes in zip(texts, split, part.column(edits).to_pylist()):
                    tree = TokenTree(text, ranks, words)
                    before = tree.total
                    for change in changes or ():
                        if change is not None:
                            tree.edit(change["start"] or 0, change["length"] or 0, change["insert"] or "")
                    rows.append((before, tree.total, sum(len(w) for w, _ in tree.leaves), tree.reencoded))
                new = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=kept + COUNTS.names)

    fields = [docs.schema[c] for c in kept]
    return docs.select(*kept, column, edits).mapInArrow(run, T.StructType(fields + COUNTS.fields))
