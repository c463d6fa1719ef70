"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; its words (runs of letters), with a mark at both ends, give
all runs of one to four characters, hashed into buckets. The text's vector is the average
of the buckets' embeddings, and a linear softmax names the language. Embeddings and
weights are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled documents. One part of the sample is held back to calibrate: a temperature makes
the score a probability, and the score that all but a small share of right answers
reach is the limit below which a text is rejected. Prediction multiplies embeddings and
weights once, so a subword adds one row of a small table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .batches import add_columns, memo, without

BUCKETS = 1 << 15
WIDTHS = (1, 2, 3, 4)
DIMENSIONS = 16
SAMPLE_ROWS = 8_000
EPOCHS = 8
RATE = 0.5
SEED = 7
CALIBRATION_SHARE = 0.2
LOST_SHARE = 0.001
MOST_CONFIDENCE = 0.6
UNKNOWN = "und"
WIDE = np.dtype("<u4")
SPAN = 1 << 19
SLICE = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the golden ratio's 64 bits


def letter_table() -> np.ndarray:
    """Whether each code point is a letter (Unicode category L)."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def subwords(texts: list[str], letters: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, text by text, and how many each text has."""
    found, owners = [], []
    for i, text in enumerate(texts):
        if text:
            for part in _parts(text):
                hashed = _hashed(part, letters, buckets)
                found.append(hashed)
                owners.append((i, len(hashed)))
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, n in owners:
        counts[i] += n
    return (np.concatenate(found) if found else np.empty(0, dtype=np.int64)), counts


def _parts(text: str):
    """Very long texts in bounded parts, cut between words where there is a gap."""
    at = 0
    while at < len(text):
        stop = min(at + SPAN, len(text))
        if stop < len(text):
            gap = text.rfind(" ", at + 1, stop)
            stop = gap if gap > at else stop
        yield text[at:stop]
        at = stop


def _hashed(text: str, letters: np.ndarray, buckets: int) -> np.ndarray:
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    inside = letters[points]
    points = np.where(inside, points, 0)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = inside[1:] | inside[:-1]  # runs of other characters are one mark
    points, inside = points[keep].astype(np.uint64), inside[keep]
    out = []
    key = np.zeros(len(points), dtype=np.uint64)
    whole = np.ones(len(points), dtype=bool)
    for width in range(1, max(WIDTHS) + 1):
        n = len(points) - width + 1
        if n <= 0:
            break
        key = (key[:n] + points[width - 1 :] + np.uint64(1)) * MIX
        key ^= key >> np.uint64(29)
        if width > 2:  # a mark may stand first or last, not between
            whole = whole[:n] & inside[width - 2 : width - 2 + n]
        else:
            whole = whole[:n]
        if width in WIDTHS:
            use = whole & (inside[:n] | inside[width - 1 :]) if width > 1 else inside[:n]
            out.append((key[use] >> np.uint64(40)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Scores per bucket (embedding times weights), bias, temperature and rejection limit."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float

    def scores(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities per text, and whether it has a subword at all."""
        letters = memo("letters", letter_table)
        texts = [t or "" for t in texts]
        found, counts = subwords(texts, letters, len(self.table))
        sums = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            for k in range(len(self.languages)):  # a column of the table stays in the cache
                sums[some, k] = np.add.reduceat(self.table[:, k].take(found), starts, dtype=np.float64)
        logits = sums / np.maximum(counts, 1)[:, None] + self.bias
        return softmax(logits / self.temperature), counts > 0


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame, key: str, column: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents by hash of their key, in equal numbers per language where there are enough."""
    labelled = docs.filter(F.col(label).isNotNull() & F.col(column).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(label).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return labelled.select(key, column, label).limit(0)
    most = max(1, rows // len(counts))
    spread = 1 << 30
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(spread))
    # first by a share of the hash range with room to spare, so no language is sorted whole
    shares = [(k, int(spread * min(1.0, (2.0 * most + 50.0) / n))) for k, n in counts.items()]
    limit = F.create_map(*[F.lit(v) for kv in shares for v in kv])[F.col(label)]
    thin = labelled.select(key, column, label, place.alias("_place")).filter(F.col("_place") < limit)
    chosen = thin.withColumn("_nth", F.row_number().over(Window.partitionBy(label).orderBy("_place", key)))
    return chosen.filter(F.col("_nth") <= most).drop("_nth")


def fit(docs: DataFrame, key: str = "doc_id", column: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> LanguageModel | None:
    """Train on a sample of at most ``rows`` labelled rows of ``docs``; None if there are none.

    Subwords are counted where the texts are: the driver receives at most ``buckets`` counts per
    sampled row.
    """

    def count(batches):
        letters = memo("letters", letter_table)
        for batch in batches:
            for place, text, lang in zip(*(batch.column(c).to_pylist() for c in ("_place", "text", "lang"))):
                found, _ = subwords([text], letters, buckets)
                if len(found):
                    number, times = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"place": [place], "lang": [lang], "buckets": [number.astype(_bucket_type(buckets)).tobytes()], "times": [_narrow(times).tobytes()]}
                    )

    chosen = sample(docs, key, column, label, rows)
    chosen = chosen.select("_place", F.col(column).alias("text"), F.col(label).cast("string").alias("lang")) if "_place" in chosen.columns else None
    if chosen is None:
        return None
    schema = "place bigint, lang string, buckets binary, times binary"
    counted = chosen.mapInArrow(count, schema).toArrow()
    if not counted.num_rows:
        return None
    model = train(counted, buckets)
    del counted
    pa.default_memory_pool().release_unused()
    return model


def _bucket_type(buckets: int) -> np.dtype:
    return np.dtype("<u2") if buckets <= 1 << 16 else WIDE


def _narrow(times: np.ndarray) -> np.ndarray:
    """Counts as bytes, or as 32-bit numbers where one is larger."""
    return times.astype(np.uint8 if times.max(initial=0) < 256 else WIDE)


def _widen(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8 if len(data) == size else WIDE)


def train(counted: pa.Table, buckets: int) -> LanguageModel:
    order = np.lexsort((np.array(counted["lang"].to_pylist()), counted["place"].to_numpy()))
    lang = np.array(counted["lang"].to_pylist())[order]
    # the sample stays as packed bytes; a text's numbers are unpacked when its turn comes
    packed = [(counted["buckets"][i].as_buffer(), counted["times"][i].as_buffer()) for i in order]

    def unpack(i: int) -> tuple[np.ndarray, np.ndarray]:
        number = np.frombuffer(packed[i][0], dtype=_bucket_type(buckets))
        times = _widen(packed[i][1], len(number)).astype(np.float32)
        return number, times / times.sum()

    names, target = np.unique(lang, return_inverse=True)
    rng = np.random.default_rng(SEED)
    held = rng.random(len(target)) < CALIBRATION_SHARE
    if held.all() or not held.any() or len(target) < 20:
        held[:] = False
    learn = np.flatnonzero(~held)
    embed = rng.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, (buckets, DIMENSIONS)).astype(np.float32)
    weight = np.zeros((DIMENSIONS, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            rate = RATE * (1.0 - step / steps)
            step += 1
            number, share = unpack(i)
            rows = embed[number]
            hidden = share @ rows
            error = softmax(hidden @ weight + bias)
            error[target[i]] -= 1.0
            back = weight @ error
            weight -= rate * np.outer(hidden, error)
            bias -= 0.01 * rate * error
            # the shares are small where a text is long: scaled, so each text moves its buckets alike
            embed[number] = rows - rate * np.outer(share / np.sqrt(np.square(share).sum()), back)
    seen = np.zeros(buckets, dtype=bool)
    for i in learn:
        seen[unpack(i)[0]] = True
    embed[~seen] = 0.0
    table = (embed @ weight).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else learn
    logits = np.array([share @ table[number] for number, share in map(unpack, check)]) + bias
    temperature, limit = calibrate(logits, target[check])
    return LanguageModel(tuple(str(n) for n in names), table, bias, temperature, limit)


def calibrate(logits: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss (one at least, so scores are never sharpened), and the score that all but a small share of right answers reach."""
    choices = np.exp(np.linspace(0.0, np.log(20.0), 61))
    rows = np.arange(len(target))
    loss = [-np.log(np.maximum(softmax(logits / t)[rows, target], 1e-12)).mean() for t in choices]
    temperature = float(choices[int(np.argmin(loss))])
    probability = softmax(logits / temperature)
    right = probability.argmax(axis=1) == target
    best = probability.max(axis=1)[right]
    limit = float(np.quantile(best, LOST_SHARE)) if len(best) else 0.0
    return temperature, min(limit, MOST_CONFIDENCE)


def identify(docs: DataFrame, model: LanguageModel | None, column: str = "text") -> DataFrame:
    """Add ``lang_pred, score, rejected`` for every whole text.

    A null text or one without a letter is ``und`` with score 0 and rejected, and so is every text
    where there was nothing to learn from. Else ``lang_pred`` is the likeliest language and
    ``rejected`` says whether its calibrated probability is below the limit. Columns named like
    the new ones are replaced.
    """
    added = T.StructType(
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    if model is None:
        docs = without(docs, added.names)
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    # buckets x languages numbers; as plain values, since workers may not have this package
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature, model.limit))

    def kernel(texts):
        m = LanguageModel(*sent.value)
        probability, some = m.scores(texts)
        best = probability.argmax(axis=1)
        score = np.where(some, probability[np.arange(len(best)), best], 0.0)
        names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
        return [pa.array(names), pa.array(score), pa.array(~some | (score < m.limit))]

    return add_columns(docs, column, kernel, added, SLICE)
