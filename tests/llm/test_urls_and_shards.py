from __future__ import annotations

import random

import numpy as np
import pytest

from fitgrid.llm import sharding, url_filter
from fitgrid.llm.queries import URL_RULES

URLS = "page_id bigint, url string, verdict string"


def slow_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), len(h), h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def random_urls(seed, number=400):
    draw = random.Random(seed)
    labels, segments = ["a", "b", "org", "com", "x-y", "A"], ["", "p", "pp", "q", "p1"]
    urls = [None, "", "no scheme", "http://", "://x", "http://org", "http://ORG/", "http://org?x/y", "http://.org/p", "http://org:80/p", "http://a.org//p"]
    for _ in range(number):
        host = ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
        path = "".join("/" + draw.choice(segments) for _ in range(draw.randint(0, 4)))
        urls.append(f"{draw.choice(['http', 'HTTPS', ''])}://{host}{path}{draw.choice(['', '?q=://z/p', '#p/q', '/'])}")
    return urls


def random_rules(seed, number=60):
    draw = random.Random(seed)
    rules = {}
    for _ in range(number):
        host = ".".join(draw.choice(["a", "b", "org", "com", "x-y"]) for _ in range(draw.randint(1, 3)))
        path = "".join("/" + draw.choice(["", "p", "q", "p1"]) for _ in range(draw.randint(1, 3)))
        rules[host + path] = f"{draw.choice(['allow', 'block'])} {host}{path}"
    return list(rules.values())


@pytest.mark.parametrize("limit", [url_filter.TRIE_BYTES, 200])
def test_same_as_brute_force(spark, limit):
    entries = [*random_rules(1), "block b", *URL_RULES]
    rules = [url_filter.parse(e) for e in entries]
    urls = random_urls(2)
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], URLS)
    rows = url_filter.judge(pages.unionByName(pages.filter("page_id = 5")), entries, limit=limit).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_judge(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_block_wins_over_allow_for_one_target(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a", "")], URLS)
    for entries in (["allow org/", "block org/"], ["block org/", "allow org/"]):
        assert url_filter.judge(pages, entries).first()["verdict"] == "block"


def test_no_rules_empty_table_and_bad_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.org/" + "a/" * 100_000, "")], URLS)
    assert url_filter.judge(pages, [], default="block").first()["verdict"] == "block"
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    for bad in ("deny org/", "allow /path"):
        with pytest.raises(ValueError):
            url_filter.parse(bad)


def test_table_is_even_and_steady():
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names, 5003)
    count = np.bincount(table)
    assert count.min() >= 250 and count.max() <= 251
    fewer = [n for n in names if n != "s7"]
    share = sharding.moved(table, sharding.lookup_table(fewer, 5003), names, fewer)
    assert 0.05 <= share < 0.15
    shuffled = sharding.lookup_table(names[::-1], 5003)
    assert (np.array(names[::-1])[shuffled] == np.array(names)[table]).all()


def test_slow_fill_agrees():
    names, slots = ["x", "y", "z"], 13
    order = {}
    for n in names:
        offset, step = sharding._hash(f"offset:{n}") % slots, sharding._hash(f"step:{n}") % (slots - 1) + 1
        order[n] = [(offset + j * step) % slots for j in range(slots)]
    owner = {}
    while len(owner) < slots:
        for n in names:
            if len(owner) < slots:
                owner[next(s for s in order[n] if s not in owner)] = n
    assert [names[i] for i in sharding.lookup_table(names, slots)] == [owner[s] for s in range(slots)]


@pytest.mark.parametrize("names,slots", [([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_placing_hard_rows(spark, hard_docs, empty_docs):
    docs = hard_docs.withColumnRenamed("other", "shard")
    rows = sharding.place(docs, ["a", "b", "c"], slots=101).collect()
    assert len(rows) == docs.count() and {r["shard"] for r in rows} <= {"a", "b", "c"}
    by_key = {}
    for r in rows:
        assert by_key.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert sharding.place(empty_docs, ["a"]).count() == 0


def test_writing_shards(spark, tmp_path):
    docs = spark.range(400).selectExpr("if(id < 150, 1, id) as doc_id", "'t' as text")
    sharding.write(docs, str(tmp_path / "out"), ["a", "b"], slots=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 400
    assert back.groupBy("doc_id").agg({"shard": "approx_count_distinct"}).filter("`approx_count_distinct(shard)` > 1").count() == 0
