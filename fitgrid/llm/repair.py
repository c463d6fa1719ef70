"""Cheapest edits that give every conversation a proper order of roles.

A proper conversation is an optional system turn followed by pairs of user and assistant turns, or
nothing: role initials ``(s?(ua)+)?``. Edits, one letter each in the audit: Keep, Rerole to user or
assistant, Delete (required for blank rows and for rows seen before), and Insert of an empty turn.

Rows are numbered and written once. A slim copy without texts is repartitioned by conversation and
sorted by row; a task walks it with dynamic programming over the four places in the pattern: what is
carried from batch to batch is, per place, the cost and the rank of the audit so far. Cost differences
stay small, so there are few distinct states of that kind, and a row is one step of an automaton built
on demand. Its steps are the backpointers, two bytes a row; those of a giant conversation go to an
unnamed file in Spark's own folder for spills, private to the task and made again with it. Edits return
as scripts of bounded length, which meet the texts in a second sorted stream.

Why places are enough for the least of equally cheap audits: a path's cost depends on its letters only, and
audits compared after a row end in a row's letter and have one such letter per row, so none is the
beginning of another.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .batches import slices
from .turns import GIANT_ROWS, numbered

SPACE = " \t\n\x0b\x0c\r"
COSTS = {"delete": 3, "insert": 2, "rerole": 2, "truncated": 1}
BLOCK = 1 << 16
OUT_ROWS = 4_096

# Places in the pattern: nothing yet, after s, after u, after a. What may follow, by role.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ENDS = ["", "UA", "A", ""]
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A place that is this much dearer than the cheapest cannot win any more: any way to end from it can
#: be followed from the cheapest with two inserts and one deletion at most.
HOPELESS = 2 * COSTS["insert"] + COSTS["delete"]
OTHER, OK, TRUNCATED, BLANK = 3, 0, 1, 2
# Scripts tell the roles apart: rerole to u or a, insert U or A. The audit does not.
LETTERS = str.maketrans("uaUA", "RRII")


def _inserts(place: int) -> list[tuple[str, int]]:
    """Up to two inserted turns and the place they lead to."""
    out = [("", place)]
    for _ in range(2):
        script, at = out[-1]
        role = "a" if "a" in NEXT[at] else "u"
        out.append((script + role.upper(), NEXT[at][role]))
    return out


class Steps:
    """The automaton: states are costs and ranks of the four places, built when first met."""

    def __init__(self):
        self.vectors: dict[tuple, int] = {}
        self.values: list[tuple] = []
        self.known: dict[int, tuple[int, int, int]] = {}
        self.back: list[dict[int, tuple[int, str]]] = []
        self.start = self._number(((0, 0), None, None, None))

    def _number(self, vector: tuple) -> int:
        if vector not in self.vectors:
            self.vectors[vector] = len(self.values)
            self.values.append(vector)
        return self.vectors[vector]

    def step(self, state: int, code: int) -> tuple[int, int, int]:
        """Next state, cost that all places have more, number of the step."""
        key = state * 12 + code
        if key not in self.known:
            self.known[key] = self._build(self.values[state], *divmod(code, 3))
        return self.known[key]

    def _build(self, vector: tuple, initial: int, fault: int) -> tuple[int, int, int]:
        best: dict[int, tuple] = {}
        for place, value in enumerate(vector):
            for script, at in _inserts(place) if value else ():
                cost = value[0] + COSTS["insert"] * len(script)
                ways = [("D", at, COSTS["delete"])]
                if fault != BLANK:
                    more = COSTS["truncated"] if fault == TRUNCATED else 0
                    for role, to in NEXT[at].items():
                        if initial < OTHER and INITIALS[initial] == role:
                            ways.append(("K", to, more))
                        if role != "s":
                            ways.append((role, to, COSTS["rerole"] + more))
                for letter, to, price in ways:
                    full = script + letter
                    found = (cost + price, value[1], full.translate(LETTERS), place, full)
                    if to not in best or found < best[to]:
                        best[to] = found
        least = min(f[0] for f in best.values())
        best = {to: f for to, f in best.items() if f[0] - least <= HOPELESS}
        ranks = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        after = tuple((best[to][0] - least, ranks[to]) if to in best else None for to in range(4))
        self.back.append({to: (f[3], f[4]) for to, f in best.items()})
        return self._number(after), least, len(self.back) - 1

    def end(self, state: int) -> tuple[int, int, str]:
        """Last place, its cost above the carried one, and the closing inserts."""
        ways = [
            (value[0] + COSTS["insert"] * len(ENDS[place]), value[1], place) for place, value in enumerate(self.values[state]) if value
        ]
        cost, _, place = min(ways)
        return place, cost, ENDS[place]


class Trail:
    """Steps of one conversation, read again from the last; full blocks go to an unnamed file."""

    def __init__(self, block: int = BLOCK):
        self.size, self.block, self.file, self.blocks = block, array("H"), None, 0

    def add(self, step: int) -> None:
        if len(self.block) == self.size:
            if self.file is None:
                folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            self.file.write(self.block.tobytes())
            self.blocks, self.block = self.blocks + 1, array("H")
        self.block.append(step)

    def back(self) -> Iterator[tuple[int, array]]:
        """Blocks from the last to the first, with the number of steps before each."""
        yield self.blocks * self.size, self.block
        for i in range(self.blocks - 1, -1, -1):
            self.file.seek(i * self.size * 2)
            block = array("H")
            block.frombytes(self.file.read(self.size * 2))
            yield i * self.size, block


class Walk:
    """What is carried along one conversation."""

    def __init__(self, steps: Steps, block: int):
        self.steps, self.state, self.cost = steps, steps.start, 0
        self.trail = Trail(block)
        self.faults = [0, 0, 0]
        self.illegal, self.initial = 0, None
        self.low, self.turn, self.distinct = None, None, 0

    def row(self, turn: int | None, code: int, first: bool) -> None:
        initial, fault = divmod(code, 3)
        kind = 0 if fault == BLANK else 1 if not first else 2 if fault == TRUNCATED else None
        if kind is not None:
            self.faults[kind] += 1
        if kind == 1:
            code = initial * 3 + BLANK
        self.state, more, step = self.steps.step(self.state, code)
        self.cost += more
        self.trail.add(step)
        if self.initial is not None and (self.initial, initial) not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.distinct = turn, self.distinct + 1

    def scripts(self) -> Iterator[tuple]:
        """Script pieces from the last to the first; the first row's piece carries the sums."""
        place, more, script = self.steps.end(self.state)
        for before, block in self.trail.back():
            pieces = [script]
            for step in reversed(block):
                place, piece = self.steps.back[step][place]
                pieces.append(piece)
            script = "".join(reversed(pieces))
            gaps = 0 if self.low is None else self.turn - self.low + 1 - self.distinct
            sums = (gaps, *self.faults, self.illegal, self.cost + more) if before == 0 else (None,) * 6
            yield before + 1, script, *sums
            script = ""


SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _walk(kind: pa.DataType, block: int):
    """Task over (conv, row, mark, turn, code), sorted: a mark before a row tells that it is the first of its kind."""
    names = ["conv", "first_row", "script", *SUMS]
    types = [kind, pa.int64(), pa.string(), *[pa.int64()] * len(SUMS)]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        steps, walk, at, first, out, letters = Steps(), None, None, False, [], 0
        for batch in batches:
            for conv, mark, turn, code in zip(*(batch.column(c).to_pylist() for c in ("conv", "mark", "turn", "code"))):
                if walk is None or conv != at:
                    for piece in walk.scripts() if walk else ():
                        out.append((at, *piece))
                        letters += len(piece[1])
                        if len(out) >= OUT_ROWS or letters >= 16 * BLOCK:
                            yield pack(out)
                            out, letters = [], 0
                    walk, at, first = Walk(steps, block), conv, False
                if mark:
                    walk.row(turn, code, first)
                    first = False
                else:
                    first = True
        for piece in walk.scripts() if walk else ():
            out.append((at, *piece))
            if len(out) >= OUT_ROWS:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return run


def _apply(kind: pa.DataType):
    """Task over (conv, row, mark, role, text), sorted: a script comes before the rows it is about."""
    names = ["conv", "place", "source", "edit", "role", "text"]
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        at, place, pieces = (), 0, iter(())
        closing = ""
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for conv, row, mark, role, text in zip(*(part.column(c).to_pylist() for c in ("conv", "row", "mark", "role", "text"))):
                    if at != (conv,):
                        at, place = (conv,), 0
                    if not mark:
                        found = re.findall("[UA]*[DKua]|[UA]+", text)
                        closing = found.pop() if found[-1][-1] in "UA" else ""
                        pieces, left = iter(found), len(found)
                        continue
                    piece = next(pieces)
                    left -= 1
                    for letter in piece + (closing if not left else ""):
                        if letter == "D":
                            continue
                        place += 1
                        if letter in "UA":
                            out.append((conv, place, None, "I", "user" if letter == "U" else "assistant", ""))
                        else:
                            kept = {"u": "user", "a": "assistant"}.get(letter, role)
                            out.append((conv, place, row, "K" if letter == "K" else "R", kept, text))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


@dataclass(frozen=True)
class Repair:
    """``summary``: one row per conversation; ``turns``: the repaired rows, each conversation in order in one partition."""

    summary: DataFrame
    turns: DataFrame


def repair(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    giant_rows: int = GIANT_ROWS,
    block: int = BLOCK,
) -> Repair:
    """Repair all conversations of ``rows``.

    Rows are taken by turn (null first), then by role and text. A row's first fault counts: ``blank`` (no
    character but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (last character
    is none of ``.!?``). A summary has the conversation's id, the faults, ``gaps`` between least and
    greatest turn (null turns aside), ``illegal`` (neighbours whose initials are not su, ua or au), the
    least ``cost`` and the ``audit``. Repaired turns have ``place`` (from 1), ``source`` (number of the
    row, null if inserted), ``edit``, role and text.

    A null role or text is one space, so such texts are blank and such roles fit nowhere; nor does an empty
    role. Rows without an id are one conversation, whose id is null. Rows repeated as a whole are duplicates.
    Texts of any length pass whole. Other columns are not read; an empty table gives no rows.
    """
    spark_type = rows.schema[conv].dataType
    given = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    given = materialise(numbered(given, "conv", "turn", ["role", "text"], "row", giant_rows), "turns")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    slim = given.select("conv", "row", F.lit(1).alias("mark"), "turn", (number * 3 + fault).alias("code"))
    # the first of each kind, found with partial aggregates: a text repeated everywhere is no hot key
    firsts = given.groupBy("conv", "role", F.md5("text")).agg(F.min("row").alias("row"))
    nothing = [F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("int").alias("code")]
    marked = slim.unionByName(firsts.select("conv", "row", F.lit(0).alias("mark"), *nothing))
    arrow = pa.int64() if spark_type.simpleString() == "bigint" else pa.string()
    name = spark_type.simpleString() if arrow == pa.int64() else "string"
    marked = marked.withColumn("conv", F.col("conv").cast(name))
    scripts = (
        marked.repartition("conv")
        .sortWithinPartitions("conv", "row", "mark")
        .mapInArrow(_walk(arrow, block), f"conv {name}, first_row bigint, script string, {', '.join(f'{s} bigint' for s in SUMS)}")
    )
    scripts = materialise(scripts, "scripts")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_row", "script"))), lambda p: p["script"]), "")
    whole = scripts.groupBy("conv").agg(*[F.max(s).alias(s) for s in SUMS], joined.alias("script"))
    audit = F.translate("script", "uaUA", "RRII").alias("audit")
    back = F.col("conv").cast(spark_type).alias(conv)

    texts = given.select(F.col("conv").cast(name).alias("conv"), "row", F.lit(1).alias("mark"), "role", "text")
    edits = scripts.select("conv", F.col("first_row").alias("row"), F.lit(0).alias("mark"), F.lit(None).cast("string").alias("role"), F.col("script").alias("text"))
    turns = (
        texts.unionByName(edits)
        .repartition("conv")
        .sortWithinPartitions("conv", "row", "mark")
        .mapInArrow(_apply(arrow), f"conv {name}, place bigint, source bigint, edit string, role string, text string")
    )
    return Repair(whole.select(back, *SUMS, audit), turns.select(back, "place", "source", "edit", "role", "text"))


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """SHA-256 of ``role:text`` of a conversation's turns, joined by line ends.

    ``turns`` come as ``repair`` returns them: a conversation is in one partition, in order.
    """
    kind = turns.schema[conv].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.string()

    def run(batches):
        at, found = (), None
        out = []
        for batch in batches:
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if at != (key,):
                    if at:
                        out.append((at[0], found.hexdigest()))
                    at, found = (key,), hashlib.sha256()
                else:
                    found.update(b"\n")
                found.update(f"{role}:{text}".encode())
            if len(out) >= OUT_ROWS:
                yield pack(out)
                out = []
        if at:
            out.append((at[0], found.hexdigest()))
            yield pack(out)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [arrow, pa.string()])], names=["conv", "sha256"])

    name = kind if arrow == pa.int64() else "string"
    slim = turns.select(F.col(conv).cast(name).alias("conv"), "role", "text")
    return slim.mapInArrow(run, f"conv {name}, sha256 string").select(F.col("conv").cast(kind).alias(conv), "sha256")
