from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import xxhash

from fitgrid.llm import QUERIES, quality

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


def hash64(*values):
    """As Spark chains them: each value's hash is the seed of the next."""
    seed = 42
    for v in values:
        if isinstance(v, str):
            seed = xxhash.xxh64_intdigest(v.encode(), seed)
        elif isinstance(v, bool):
            seed = xxhash.xxh64_intdigest(int(v).to_bytes(4, "little"), seed)
        else:
            seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >> 63 else seed


def shape(word):
    """Runs of small letters are one a, of capitals one A."""
    out, last = "", None
    for c in word:
        kind = {"Ll": "a", "Lu": "A"}.get(unicodedata.category(c))
        if kind is None or kind != last:
            out += kind or c
        last = kind
    return out


def slow_scores(docs, trusted, wb, sb):
    raw, target, grams = Counter(), Counter(), []
    for key, text in docs:
        w = words(text)
        found = [hash64(x) % wb for x in w]
        s = [hash64(shape(x)) for x in w]
        found += [wb + hash64(s[i], s[i + 1], w[i] == w[i + 1]) % sb for i in range(len(w) - 1)]
        grams.append(found)
        raw.update(found)
        if key in trusted:
            target.update(found)
    weight = {}
    for low, high in ((0, wb), (wb, wb + sb)):
        r, t, n = sum(raw[b] for b in range(low, high)), sum(target[b] for b in range(low, high)), high - low
        for b in range(low, high):
            share = (raw[b] + 1) / (r + n)
            weight[b] = math.log((target[b] + n * share) / (t + n) / share)
    return [sum(weight[b] for b in g) / max(1, len(words(d[1]))) for g, d in zip(grams, docs)]


def test_counts_scores_and_verdicts(spark, hard_docs):
    texts = ["Plain words of a quiet text that goes on for a while and then ends. " * 1, "!!! ### || " * 30, "one two three four five six seven eight " * 5]
    more = spark.createDataFrame([(100 + i, t, "en", "s", 1, "-") for i, t in enumerate(texts)], hard_docs.schema)
    docs = hard_docs.unionByName(more).withColumnRenamed("other", "score")
    trusted = spark.createDataFrame([(7,), (100,)], "doc_id bigint")
    rows = quality.assess(docs, trusted, threshold=-0.05, word_buckets=64, shape_buckets=32).collect()
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = {k: s for k, s in zip(map(repr, plain), slow_scores(plain, {7, 100}, 64, 32))}
    assert len(rows) == len(plain)
    for r in rows:
        n, *others = slow_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *others)
        assert r["base_failed"] == (n < 20 or 100 * others[-1] > 30 * n)
        want = scores[repr((r["doc_id"], r["text"]))]
        assert abs(r["score"] - want) < 1e-3
        assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.05)


def test_empty_tables(spark, empty_docs, make_docs):
    none = spark.createDataFrame([], "doc_id bigint")
    assert quality.assess(empty_docs, none).count() == 0
    rows = quality.assess(make_docs(["word " * 3 + " ".join(f"w{i}" for i in range(40))]), none).collect()
    assert abs(rows[0]["score"]) < 1e-3 and rows[0]["kept"]


def test_trusted_sample_is_bounded(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert quality.trusted_keys(labels).count() == 10_000
    assert 800 < quality.trusted_keys(labels, most=1000).count() < 1200


def test_query(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    rows = QUERIES["op3_quality"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == slow_counts(texts[r["doc_id"]])
    # clean documents of some length stay, bad ones go
    assert all(r["kept"] or r["base_failed"] for r in rows if labels.get(r["doc_id"]) == 1)
    assert not any(r["kept"] for r in rows if labels.get(r["doc_id"]) == 0)


def test_all_trusted_labels_count(spark, make_docs, monkeypatch):
    labels = spark.range(200_002).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert quality.trusted_keys(labels).count() == 100_001
    docs = make_docs([f"quite plain words number {i} and some more of them" for i in range(6)])
    trusted = spark.createDataFrame([(i,) for i in range(3)], "doc_id bigint")
    want = sorted(quality.assess(docs, trusted).select("doc_id", "score").collect())
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 2)
    assert sorted(quality.assess(docs, trusted).select("doc_id", "score").collect()) == want
