"""Allow and block rules for URLs in a trie over reversed host labels and path segments.

A rule is a host and the start of a path. Its host labels, last one first, then its
whole path segments, lead to a node; what the rule has of a last, unfinished segment is
kept there. Walking a URL's labels and segments down the trie meets all rules that fit it; the
longest wins. The trie is broadcast. Rules beyond ``TRIE_BYTES`` go into several tries, one
pass each, and the longest of their answers wins: the same result at any number of rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .batches import without

TRIE_BYTES = 32 << 20
DEFAULT = "allow"
RULE, HOST, PATH, LAST = 0, 1, 2, 3  # places in a node
Rule = tuple[str, str, str]  # verdict, host, path
# The letters that lose their case in hosts.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(entry: str) -> Rule:
    """``allow org/`` or ``block example.org/es/``: verdict, then host and path in one."""
    verdict, _, target = entry.strip().partition(" ")
    if verdict not in ("allow", "block"):
        raise ValueError(f"a rule begins with allow or block: {entry!r}")
    host, slash, path = target.strip().partition("/")
    if not host:
        raise ValueError(f"a rule needs a host: {entry!r}")
    return verdict, host.translate(LOWER), slash + path


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for a null or one without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def make_trie(rules: Iterable[Rule]) -> list:
    """Nodes as plain lists ``[rule, labels, segments, unfinished]``.

    Of two rules for one host and path, block wins.
    """
    root: list = [None, {}, {}, {}]
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node[HOST].setdefault(label, [None, {}, {}, {}])
        segments = path.split("/")
        for segment in segments[:-1]:
            node = node[PATH].setdefault(segment, [None, {}, {}, {}])
        known = node[LAST].get(segments[-1])
        if known is None or verdict == "block":
            node[LAST][segments[-1]] = (len(host) + len(path), len(host), host + path, verdict)
    return root


def longest(trie: list, host: str, path: str) -> tuple | None:
    """The longest rule that fits, as (length, length of its host, text, verdict)."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node[HOST].get(label)
        if node is None:
            break
        inside = node
        for i, segment in enumerate(segments):
            for start, rule in _starts(inside[LAST], segment):
                if best is None or rule > best:
                    best = rule
            if i + 1 == len(segments):
                break
            inside = inside[PATH].get(segment)
            if inside is None:
                break
    return best


def _starts(entries: dict, segment: str) -> Iterable:
    """Entries that the segment begins with."""
    if len(entries) <= len(segment):
        return [e for e in entries.items() if segment.startswith(e[0])]
    return [(segment[:n], entries[segment[:n]]) for n in range(len(segment) + 1) if segment[:n] in entries]


def chunks(rules: Sequence[Rule], limit: int = TRIE_BYTES) -> list[list[Rule]]:
    """Rules in parts whose text stays below the limit."""
    parts: list[list[Rule]] = [[]]
    size = 0
    for rule in rules:
        size += sum(map(len, rule)) + 64
        if size > limit and parts[-1]:
            parts.append([])
            size = sum(map(len, rule)) + 64
        parts[-1].append(rule)
    return parts


def judge(
    pages: DataFrame, entries: Sequence[str], column: str = "url", default: str = DEFAULT, limit: int = TRIE_BYTES
) -> DataFrame:
    """Add ``host, path, rule, verdict`` for every row.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest (host and
    path together) wins, then the one with the longer host; of rules for one target, block. Without a
    fitting rule ``rule`` is null and the verdict is ``default``; so for null URLs. Columns named like
    the new ones are replaced, the others pass through.
    """
    found = without(pages, FOUND.names)
    kept, kinds = found.columns, found.schema.fields
    for number, part in enumerate(chunks([parse(e) for e in entries], limit)):
        trie = pages.sparkSession.sparkContext.broadcast(make_trie(part))
        found = _judged(found, trie, column, kept, kinds, default, number == 0)
    return found.select(*kept, *FOUND.names)


FOUND = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


def _judged(pages: DataFrame, trie, column: str, kept: list[str], kinds: list, default: str, first: bool) -> DataFrame:
    """One pass; later passes replace an answer by a longer one of their own trie."""

    def run(batches):
        for batch in batches:
            urls = batch.column(column).to_pylist()
            before = [None] * len(urls) if first else list(zip(batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()))
            rows = []
            for url, old in zip(urls, before):
                host, path = split_url(url)
                best = longest(trie.value, host, path)
                if old and old[0] is not None:
                    # hosts have no slash, so a rule's text gives the length of its host
                    kept_rule = (len(old[0]), len(old[0].partition("/")[0]), *old)
                    best = max(best, kept_rule) if best else kept_rule
                rows.append((host, path, best[2] if best else None, best[3] if best else default))
            columns = list(zip(*rows)) if rows else [()] * 4
            new = [pa.array(list(c), pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=kept + FOUND.names)

    return pages.mapInArrow(run, T.StructType(kinds + FOUND.fields))
