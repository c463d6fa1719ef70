from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import pytest

from fitgrid.llm import repair
from fitgrid.llm.conversations import damaged

from .test_registry import same_as_sql

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, script string, conv string"
PROPER = re.compile(r"(s?(ua)+)?\Z")


def slow(rows):
    """Summary and repaired lines of one conversation by trying edits in the order of their cost."""
    rows = sorted((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows)
    seen, faults, kinds = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault is not None:
            kinds[fault] += 1
    turns = [t for there, t, _, _ in rows if there]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    paths = {("", ""): (0, ())}  # audit and initials so far: cost, lines
    inserts = ["", "u", "a", "ua", "au"]
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for ((audit, word), (cost, lines)), more in product(paths.items(), inserts):
            ways = [("D", "", 3, ())]
            if fault not in (0, 1):
                price = 1 if fault == 2 else 0
                ways += [("K", role[:1] or "?", price, (f"{role}:{text}",))] + [("R", n[0], 2 + price, (f"{n}:{text}",)) for n in ("user", "assistant")]
            added = tuple({"u": "user:", "a": "assistant:"}[m] for m in more)
            for letter, initial, price, line in ways:
                grown = word + more + initial
                if not any(PROPER.match(grown + rest) for rest in ("", "a", "ua")):
                    continue
                # what may follow depends on the last initial only
                key = (audit + "I" * len(more) + letter, grown[-1:])
                found = (cost + 2 * len(more) + price, lines + added + line)
                if key not in after or found < after[key]:
                    after[key] = found
        best = {}
        for (audit, word), (cost, lines) in after.items():
            best[word] = min(best.get(word, (cost, audit, lines)), (cost, audit, lines))
        paths = {(audit, "s" if w == "s" else "ua"[: 1 + (w == "a")] if w else ""): (cost, lines) for w, (cost, audit, lines) in best.items()}
    ends = []
    for (audit, word), (cost, lines) in paths.items():
        for more in inserts:
            if PROPER.match(word + more):
                ends.append((cost + 2 * len(more), audit + "I" * len(more), lines + tuple({"u": "user:", "a": "assistant:"}[m] for m in more)))
    cost, audit, lines = min(ends)
    return (gaps, *kinds, illegal, cost, audit), "\n".join(lines)


def check(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "-", "-", "-") for r in rows], SCHEMA)
    found = repair.repair(frame, **kw)
    summary = {r["conv_id"]: tuple(r[c] for c in [*repair.SUMS, "audit"]) for r in found.summary.collect()}
    lines, groups = {}, {}
    for r in found.turns.orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert r["place"] == len(lines[r["conv_id"]]) and (r["source"] is None) == (r["edit"] == "I")
    shas = {r["conv_id"]: r["sha256"] for r in repair.digests(found.turns).collect()}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(rest)
    assert set(summary) == set(groups) and set(shas) == set(lines)
    for conv, part in groups.items():
        want, text = slow(part)
        assert (conv, summary[conv]) == (conv, want)
        assert "\n".join(lines.get(conv, [])) == text
        if conv in lines:
            assert shas[conv] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_edits(spark, small):
    draw = random.Random(small)
    rows = []
    for conv in range(300):
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = draw.choice(["One.", "Two!", "three", "", " \t", "Four?\n", "a. ", "b"]) + draw.choice(["", f" {draw.randrange(9)}."])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), role, text))
    check(spark, rows, **({"giant_rows": 5, "block": 2} if small else {}))


def test_hard_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "user", "Hi."),
        (None, 1, "assistant", "Yes."), (None, 2, "user", "x" * 100_000 + "."), (2, 1, "", "Text."), (3, 9, "system", "Only."), (4, None, "user", " "),
    ]
    check(spark, rows)
    check(spark, rows, giant_rows=1, block=1)


def test_empty_table(spark):
    found = repair.repair(spark.createDataFrame([], SCHEMA))
    assert found.summary.count() == found.turns.count() == repair.digests(found.turns).count() == 0


def test_one_long_conversation(spark):
    rows = [(7, i, ["user", "assistant"][i % 2] if i % 50 else "system", f"Turn {i % 700}.") for i in range(3000)] + [(8, 0, "user", "Q?")]
    frame = spark.createDataFrame([(*r, "-", "-", "-") for r in rows], SCHEMA)
    whole, parts = (repair.repair(frame, **kw) for kw in ({}, {"giant_rows": 100, "block": 64}))
    for name in ("summary", "turns"):
        assert sorted(getattr(whole, name).collect(), key=repr) == sorted(getattr(parts, name).collect(), key=repr)


def test_automaton_stays_small():
    steps, draw = repair.Steps(), random.Random(3)
    state = steps.start
    for _ in range(20_000):
        state = steps.step(state, draw.randrange(12))[0]
    assert len(steps.back) < 5_000


def test_damage(spark):
    rows = spark.createDataFrame([(c, t, "system", "A. b? c!", "x") for c in range(30) for t in (0, None)], "conv_id long, turn long, role string, text string, copy string")
    kinds = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in damaged(rows).collect()}
    assert damaged(rows).columns == ["conv_id", "turn", "role", "text"]
    assert {("system", ""), ("system", "A b c"), ("user", "A. b? c!"), ("system", "A. b? c!")} == set(kinds.values())


def test_equals_sql(spark, sf):
    same_as_sql(spark, sf, "op12_repair")
