"""Repeated runs of lines across documents, by winnowing.

A run counts from ``min_words`` words on. For every line the shortest window of
whole lines with that many words is taken forwards from it and backwards to it; the
least line hash in a window is its fingerprint, so two copies of a run choose the
same lines. Fingerprints that occur at one place only are done with. Windows around
the others extend to both sides of the fingerprint, and a window whose content stands
earlier in the corpus is a later repeat. A repeated run of at least ``min_words`` words
is the union of its windows: none of its lines is missed, and no line goes that is not
in such a run. Every line keeps its first occurrence.

All steps are DataFrame operations on hashes and positions; positions are compared
with the first one of their kind, never with each other, so a line that every
document holds costs one row per document. Texts are read once for the hashes and once
for the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .batches import without

MIN_WORDS = 50
BLANKS = " \t\n\x0b\x0c\r"
OWN = ["_lines", "_body", "_runs", "_id", "_from", "n_lines", "n_deleted", "runs"]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and control blanks."""
    plain = F.translate(text, BLANKS, " " * len(BLANKS))
    return F.size(F.array_remove(F.split(plain, " "), ""))


def repeated_runs(docs: DataFrame, key: str, lines: str, body: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, body, runs``: the later repeated runs of each document, as (first, last) line.

    ``lines`` is an array of text; ``key`` and ``body`` together name a document. Documents
    are in the order of ``key`` (nulls last), then ``body``.
    """
    # two hashes of 64 bits each: at 10^12 lines one would collide
    hashed = F.transform(
        lines,
        lambda line, i: F.struct(
            i.alias("pos"),
            word_count(line).alias("n"),
            F.xxhash64(F.btrim(line, F.lit(BLANKS))).alias("h"),
            F.xxhash64(F.lit(1), F.btrim(line, F.lit(BLANKS))).alias("g"),
        ),
    )
    slim = docs.select(F.col(key).alias("_id"), F.col(body).alias("_body"), F.filter(hashed, lambda x: x["n"] > 0).alias("_lines"))
    one = slim.groupBy("_id", "_body").agg(F.any_value("_lines").alias("_lines"))  # repeated rows are one document
    rows = one.select("_id", "_body", F.inline("_lines"))
    upto = Window.partitionBy("_id", "_body").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
    both = [_windows(rows, "start", (0, min_words - 1)), _windows(rows, "end", (1 - min_words, 0))]
    windows = None
    for side, found in enumerate(both):
        found = found.filter(F.col("words") >= min_words).withColumn("side", F.lit(side).cast("tinyint"))
        windows = found if windows is None else windows.unionByName(found)
    windows = materialise(windows.drop("words"), "windows")  # read by four of the steps below
    where = F.xxhash64("_id", "_body", "chosen")
    prints = windows.groupBy("side", "mark").agg(F.min(where).alias("one"), F.max(where).alias("other"))
    shared = prints.filter("one <> other").select("side", "mark")
    candidates = windows.join(shared, ["side", "mark"], "left_semi").drop("mark", "chosen")
    # null keys come last
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_body").alias("body"), F.col("a").alias("pos"))
    firsts = candidates.groupBy("side", "h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = candidates.join(firsts.drop("n"), ["side", "h", "g"]).filter(place > F.col("first"))
    later = later.select("_id", "_body", "a", "b").distinct()
    # merge overlapping and touching windows of a document into runs
    before = Window.partitionBy("_id", "_body").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("a") > F.max("b").over(before) + 1, F.lit(True))
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("_id", "_body").orderBy("a", "b"))
    runs = later.withColumn("opens", opens).withColumn("run", number)
    runs = runs.groupBy("_id", "_body", "run").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    listed = runs.groupBy("_id", "_body").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    return listed.select(F.col("_id").alias(key), F.col("_body").alias(body), "runs")


def _windows(rows: DataFrame, offset: str, reach: tuple[int, int]) -> DataFrame:
    """The window of each line: its lines, words, fingerprint with its line, and content."""
    frame = Window.partitionBy("_id", "_body").orderBy(offset).rangeBetween(*reach)
    found = rows.select(
        "_id", "_body",
        F.min("pos").over(frame).alias("a"),
        F.max("pos").over(frame).alias("b"),
        F.sum("n").over(frame).alias("words"),
        F.min(F.struct("h", "g", (-F.col("pos")).alias("pos"))).over(frame).alias("least"),  # the last of equal minima
        F.collect_list("h").over(frame).alias("hs"),
        F.collect_list("g").over(frame).alias("gs"),
    )
    # the fingerprint only picks candidates, so half of its hash will do; content is compared by both
    return found.select(
        "_id", "_body", "a", "b", "words",
        F.col("least.h").alias("mark"),
        (-F.col("least.pos")).alias("chosen"),
        F.xxhash64("hs").alias("h"),
        F.xxhash64(F.lit(1), "gs").alias("g"),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted, and ``n_lines, n_deleted, runs``.

    ``runs`` lists the deleted (first, last) line numbers from 0, blank lines between
    matching ones included. Documents come in the order of ``key``, nulls last. Rows that
    agree in key and text are one document and get the same result. A null text stays null with no
    lines; an empty one has one blank line. Columns named like the new ones are replaced.
    """
    docs = without(docs, OWN)
    split = docs.withColumn("_body", F.xxhash64(column))
    found = repeated_runs(split.select(key, "_body", F.split(column, "\n").alias("_lines")), key, "_lines", "_body", min_words)
    found = found.select(F.col(key).alias("_id"), F.col("_body").alias("_from"), "runs")
    joined = split.join(found, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_body") == F.col("_from")), "left")
    runs = F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>"))
    lines = F.split(column, "\n")
    return joined.select(
        *[c for c in docs.columns if c != column],
        F.when(F.size(runs) > 0, _kept(lines, runs)).otherwise(F.col(column)).alias(column),
        F.when(F.col(column).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.aggregate(runs, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1).alias("n_deleted"),
        runs.alias("runs"),
    )


def _kept(lines: Column, runs: Column) -> Column:
    """The lines between the runs, joined again; linear in the lines."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    stops = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    parts = F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.array_join(F.flatten(parts), "\n")
