from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from fitgrid.llm import QUERIES, langid

WORDS = {
    "en": "the of and that this with from water house thing where",
    "de": "der und nicht schön über straße wasser haus dinge wäre",
    "fr": "le été où garçon être chose maison voilà près avec",
}


def corpus(spark, number=240):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(number):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(corpus(spark))


def test_tells_languages_apart_and_rejects_the_rest(spark, model):
    texts = [(1, "where is the house"), (2, "wäre das haus schön"), (3, "près de la maison"), (4, "Это русский текст"), (5, "这是一个测试"), (6, "123 !!"), (7, None), (8, "")]
    docs = spark.createDataFrame([(*t, "mine") for t in texts], "doc_id bigint, text string, SCORE string")
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["en", "de", "fr"]
    assert not any(rows[i]["rejected"] for i in (1, 2, 3))
    assert all(rows[i]["rejected"] for i in (4, 5, 6, 7, 8))
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0.0 for i in (6, 7, 8))
    assert all(0.0 <= r["score"] <= 1.0 for r in rows.values())


def test_same_model_whatever_the_partitions(spark, model):
    again = langid.fit(corpus(spark).repartition(7))
    assert np.array_equal(again.table, model.table) and again.limit == model.limit


def test_long_text_in_parts_gives_the_same_subwords(monkeypatch):
    letters = langid.letter_table()
    text = "some words über alles " * 50
    whole, _ = langid.subwords([text], letters)
    monkeypatch.setattr(langid, "SPAN", 64)
    parts, count = langid.subwords([text], letters)
    assert np.array_equal(np.sort(whole), np.sort(parts)) and count[0] == len(parts)


def test_subwords_stay_inside_words():
    letters = langid.letter_table()
    one, _ = langid.subwords(["ab cd"], letters)
    two, _ = langid.subwords(["cd -- AB"], letters)
    assert np.array_equal(np.sort(one), np.sort(two))


def test_sample_is_bounded_and_even(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'text' as text", "if(id % 10 = 0, 'x', 'y') as lang")
    counts = {r[0]: r[1] for r in langid.sample(docs, "doc_id", "text", "lang", 200).groupBy("lang").count().collect()}
    assert counts == {"x": 100, "y": 100}


def test_nothing_to_learn_from(spark, hard_docs, empty_docs):
    assert langid.fit(empty_docs) is None
    assert langid.fit(hard_docs.selectExpr("doc_id", "text", "cast(null as string) as lang")) is None
    rows = langid.identify(hard_docs, None).collect()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in rows)


def test_hard_documents(hard_docs, empty_docs, model):
    rows = langid.identify(hard_docs, model).collect()
    assert len(rows) == hard_docs.count() and all(np.isfinite(r["score"]) for r in rows)
    assert langid.identify(empty_docs, model).count() == 0


def test_calibration_softens_only():
    rng = np.random.default_rng(1)
    target = rng.integers(0, 3, 400)
    sure = np.eye(3)[target] * 50.0
    temperature, limit = langid.calibrate(sure, target)
    assert temperature == 1.0 and limit <= langid.MOST_CONFIDENCE
    noisy = np.eye(3)[rng.integers(0, 3, 400)] * 50.0
    assert langid.calibrate(noisy, target)[0] > 10.0


def test_query_on_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language"](spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    assert np.mean([r["rejected"] for r in held]) < 0.01


def slow_scores(model, text):
    """Subword by subword: hash, embedding row, average, softmax."""
    marks = [0]
    for char in (text or "").lower() + " ":
        if char.isalpha():
            marks.append(ord(char))
        elif marks[-1]:
            marks.append(0)
    total, count = [0.0] * len(model.languages), 0
    for start in range(len(marks)):
        key = 0
        for width in range(1, 5):
            if start + width > len(marks):
                break
            run = marks[start : start + width]
            key = (key + run[-1] + 1) * int(langid.MIX) % 2**64
            key ^= key >> 29
            if (run[0] or run[-1]) and all(run[1:-1]):
                row = model.table[(key >> 40) % len(model.table)]
                total = [t + float(r) for t, r in zip(total, row)]
                count += 1
    if not count:
        return None
    logits = [(t / count + float(b)) / model.temperature for t, b in zip(total, model.bias)]
    each = [math.exp(v - max(logits)) for v in logits]
    return [e / sum(each) for e in each]


def test_predictions_equal_a_plain_loop(spark, sf, model, hard_docs):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += [r["text"] for r in hard_docs.collect()] + ["a", "Ä-ö", "x1y", "İstanbul ǅ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in langid.identify(docs, model).collect():
        want = slow_scores(model, r["text"])
        if want is None:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["score"] == pytest.approx(max(want), abs=1e-6)
            assert r["lang_pred"] == model.languages[int(np.argmax(want))] or sorted(want)[-1] - sorted(want)[-2] < 1e-6
            assert r["rejected"] == (r["score"] < model.limit)


def test_clashing_columns_are_replaced(spark, model):
    docs = spark.createDataFrame([(1, "the house", "a", 2, "c")], "doc_id bigint, text string, lang_pred string, score int, Rejected string")
    found = langid.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "rejected"] and found.first()["lang_pred"] == "en"
