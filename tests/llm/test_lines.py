from __future__ import annotations

import random

import pytest

from fitgrid.llm import line_dedup

from .test_registry import same_as_sql

BLANKS = " \t\n\x0b\x0c\r"


def words(line):
    for b in BLANKS:
        line = line.replace(b, " ")
    return len([w for w in line.split(" ") if w])


def slow(docs, least):
    """Every window of whole lines from and to each line; later repeats go."""
    seen, gone = {}, {}
    for key, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        if text is None:
            continue
        lines = [(i, x.strip(BLANKS), words(x)) for i, x in enumerate(text.split("\n")) if words(x)]
        for side in (0, 1):
            for a in range(len(lines)):
                span, total = [], 0
                for x in lines[a:] if side == 0 else lines[a::-1]:
                    if total >= least:
                        break
                    span.append(x)
                    total += x[2]
                if total >= least:
                    span.sort()
                    content = (side, tuple(x[1] for x in span))
                    place = (key, span[0][0])
                    if seen.setdefault(content, place) != place:
                        gone.setdefault(key, set()).update(range(span[0][0], span[-1][0] + 1))
    return gone


def random_docs(seed, number=60):
    draw = random.Random(seed)
    pool = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(1, 6))) for _ in range(25)]
    docs = []
    for i in range(number):
        lines = [draw.choice(pool + ["", "  "]) for _ in range(draw.randint(0, 14))]
        if docs and draw.random() < 0.5:
            other = draw.choice(docs)[1].split("\n")
            at = draw.randint(0, len(other))
            lines[3:3] = other[at : at + draw.randint(1, 8)]
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_same_lines_as_brute_force(spark, seed):
    docs = random_docs(seed)
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=10).collect()
    want = slow(docs, 10)
    assert len(rows) == len(docs)
    for r in rows:
        lines, gone = docs[r["doc_id"]][1].split("\n"), want.get(r["doc_id"], set())
        assert r["n_lines"] == len(lines) and r["n_deleted"] == len(gone)
        assert {i for run in r["runs"] for i in range(run["first"], run["last"] + 1)} == gone
        assert r["text"] == "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_planted_passage_goes_and_the_rest_stays(make_docs):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(12)) for i in range(5))  # 60 words in five lines
    texts = [f"own {i} line before\n{passage}\nown {i} line behind" for i in range(5)] + ["nothing shared here\np00 p01"]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(make_docs(texts)).collect()}
    assert rows[0]["text"] == texts[0] and rows[5]["text"] == texts[5]
    for i in range(1, 5):
        assert rows[i]["text"] == f"own {i} line before\nown {i} line behind" and rows[i]["n_deleted"] == 5


def test_tail_below_the_least_length_goes_with_its_run(make_docs):
    head, tail = " ".join(f"h{i}" for i in range(50)), " ".join(f"t{i}" for i in range(30))
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make_docs([f"{head}\n{tail}", f"x\n{head}\n{tail}\ny", tail])).collect()}
    assert rows[1] == "x\ny" and rows[2] == tail


def test_hard_documents(hard_docs):
    docs = hard_docs.withColumnRenamed("other", "runs")
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["n_deleted"] == 0 for r in rows)
    by_key = {r["doc_id"]: r for r in rows}
    assert by_key[0]["text"] is None and by_key[0]["n_lines"] == 0 and by_key[1]["n_lines"] == 1


def test_order_of_rows_without_a_key(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text)], "doc_id bigint, text string")
    rows = line_dedup.dedup_lines(docs).collect()
    assert sorted((repr(r["doc_id"]), r["text"]) for r in rows) == [("3", text), ("3", text), ("None", "")]


def test_empty_table(empty_docs):
    assert line_dedup.dedup_lines(empty_docs).count() == 0


def test_query(spark, sf):
    same_as_sql(spark, sf, "op6_line_dedup")
