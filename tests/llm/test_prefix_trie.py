from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from fitgrid.llm import prefix_trie
from fitgrid.llm.conversations import rebuilt

from .test_registry import same_as_sql

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, `key` string, z1 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text))
    return {c: [(r, x) for _, _, r, _, x in sorted(turns)] for c, turns in convs.items()}


def slow_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def slow(convs):
    """All prefixes one by one."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, found in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        ends = ",".join(str(c) for c in sorted(c for c in found if len(convs[c]) == len(prefix)))
        out.append(
            (
                min(found), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(found),
                sum(len(p) == len(prefix) + 1 for p in below),
                sum(not any(q[:-1] == p and q for q in below) for p in below),
                sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def found(spark, rows, change=None, giant_rows=10**6, **kw):
    frame = spark.createDataFrame([(*r, "-", "-", "-") for r in rows], SCHEMA)
    turns = prefix_trie.slim_turns(frame, giant_rows=giant_rows)
    ids = frame.select("conv_id").filter("conv_id is not null").distinct()
    turns = rebuilt(turns, ids) if change else turns
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(turns, ids, **kw).collect()), key=repr)


def corpus(seed):
    """Conversations that share beginnings of many lengths, whole copies, snapshots of one that grows."""
    draw = random.Random(seed)
    stems = [[("user", f"t{draw.randrange(40)} {s}") for _ in range(draw.randint(1, 20))] for s in range(4)]
    rows = []
    for conv in range(60):
        stem = draw.choice(stems)
        turns = stem[: draw.randint(0, len(stem))] + [("assistant", f"x{draw.randrange(3)}") for _ in range(draw.randint(0, 4))]
        rows += [(conv * 7, i, *t) for i, t in enumerate(turns)]
    rows += [(1000 + n, i, "user", f"grow {i}") for n in range(1, 14) for i in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "chunk": 2, "giant_rows": 4}])
def test_equals_all_prefixes(spark, sizes):
    rows = corpus(len(sizes))
    assert found(spark, rows, **sizes) == slow(ordered(rows))


def test_rebuilt_conversations(spark):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", None]), f"text {draw.randrange(4)}") for c in [*range(0, 30), *range(250, 262), 300, 301] for t in range(draw.randint(1, 8))]
    assert found(spark, rows, change=True) == slow(slow_rebuilt(ordered(rows)))


def test_hard_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", ""), (1, 3, "user", "x" * 100_000), (2, 0, "", ""), (2, 0, "", ""), (3, 1, "", ""),
        (None, 1, "user", "lost"), (4, 5, "user", "ß中😀"), (5, 5, "user", "ß中😀"), (-7, 1, "", ""),
    ]
    assert found(spark, rows) == slow(ordered(rows))
    assert found(spark, rows, block=1, chunk=1, giant_rows=1) == slow(ordered(rows))


def test_turnless_members_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", "", "", "")], SCHEMA)
    ids = spark.createDataFrame([(i,) for i in (3, 1, 2)], "id long")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(prefix_trie.slim_turns(frame), ids).collect())
    assert got == sorted(slow({1: [("user", "a")], 2: [], 3: []}), key=lambda r: (r[0], r[1]))
    assert found(spark, []) == []


def test_equals_sql(spark, sf):
    same_as_sql(spark, sf, "op11_prefix_trie")
