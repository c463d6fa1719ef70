"""Quality rules: counts by rule, and an n-gram likelihood ratio of trusted against raw text.

The n-grams are words and pairs of neighbouring word shapes ("Aa", "a.", "A!!", with a
mark where a word repeats its predecessor), hashed into a fixed number of buckets.
Bucket counts of all documents make the raw multinomial, those of trusted documents the
target one. A document's score is its log-likelihood ratio per word, and every
document is held to one threshold. All of it is DataFrame expressions inside the row:
the only shuffle is that of bucket counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .batches import without

# What parts words, and which characters count as symbols.
BLANK = r"[\x20\x09-\x0D]+"
EDGES = " \t\n\x0b\x0c\r"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30

WORD_BUCKETS = 1 << 16
SHAPE_BUCKETS = 1 << 12
BROADCAST_KEYS = 100_000
THRESHOLD = -0.8
END = 1 << 30  # as a length: to the end
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OWN = [*COUNTS, "base_failed", "score", "kept", "_words", "_hashes", "_pairs", "_fours", "_eights", "_grams", "_at", "_next", "_starts", "_lines", "_shapes", "_trusted"]


def _after(values: str, gap: int) -> Column:
    """``xxhash64(values[i], values[i + gap])``; the last ``gap`` of them have no partner and mean nothing."""
    return F.zip_with(F.col(values), F.slice(values, 1 + gap, END), lambda a, b: F.xxhash64(a, b))


def hashed(docs: DataFrame, column: str) -> DataFrame:
    """Add ``_hashes`` of the words and ``_shapes``, hashes of their shapes: numbers are cheaper to carry than texts."""
    text = F.btrim(F.coalesce(F.col(column), F.lit("")), F.lit(EDGES))
    # runs of small letters and of capitals become one letter; all else stays as it is
    outline = F.regexp_replace(F.regexp_replace(text, r"\p{Ll}++", "a"), r"\p{Lu}++", "A")
    none = F.array().cast("array<bigint>")

    def hashes(part: Column) -> Column:
        return F.when(part == "", none).otherwise(F.transform(F.split(part, BLANK), lambda w: F.xxhash64(w)))

    return docs.withColumns({"_hashes": hashes(text), "_shapes": hashes(outline)})


def base_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """Add the rule counts and ``base_failed`` to documents with ``_hashes``.

    Windows are told apart by 64-bit hashes: two different ones among a million words of a text
    agree with a chance below 10^-7. Every step is a column of its own, so none is computed twice.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    found = docs.withColumn("_pairs", _after("_hashes", 1)).withColumn("_fours", _after("_pairs", 2))
    found = found.withColumn("_eights", _after("_fours", 4))
    found = found.withColumn("_grams", F.slice("_eights", 1, F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))))
    found = found.withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(EDGES)) != ""))
    # sorted windows exist for texts that repeat one only
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    at = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = found.withColumn("_at", F.when(repeats, at).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    found = found.withColumn("_next", F.slice("_at", 2, END))
    # neighbours of equal hash in the sorted order: both of each such pair are repeats
    same = F.zip_with("_at", "_next", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    found = found.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    found = found.withColumns(
        {
            "n_words": F.size("_hashes").cast("bigint"),
            "word_chars": F.length(F.regexp_replace(text, BLANK, "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": covered.cast("bigint"),
        }
    ).drop("_pairs", "_fours", "_eights", "_grams", "_at", "_next", "_starts", "_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def grams() -> Column:
    """Word, shape, next word and next shape (as hashes) of every word."""
    after = [F.slice(c, 2, END).alias(n) for c, n in (("_hashes", "g"), ("_shapes", "t"))]
    return F.arrays_zip(F.col("_hashes").alias("h"), F.col("_shapes").alias("s"), *after)


def _word_bucket(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words)).cast("int")


def _shape_bucket(h: Column, s: Column, g: Column, t: Column, words: int, shapes: int) -> Column:
    """Bucket of a pair of shapes, behind those of words; null after the last word."""
    return F.when(g.isNotNull(), F.pmod(F.xxhash64(s, t, h == g), F.lit(shapes)).cast("int") + words)


def weights(docs: DataFrame, trusted: DataFrame, key: str, words: int = WORD_BUCKETS, shapes: int = SHAPE_BUCKETS) -> DataFrame:
    """``bucket, weight``: the log-likelihood ratio of every bucket.

    ``docs`` has ``_hashes`` and ``_shapes``; ``trusted`` is a table of distinct keys, broadcast up to
    ``BROADCAST_KEYS`` of them and else met by a shuffle of the hashed rows. Target counts are smoothed towards the raw shares with the weight of one count per bucket, so the
    ratio of n-grams without evidence is near zero.
    """
    known = trusted.select(F.col(key), F.lit(1).alias("_trusted"))
    if trusted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        known = F.broadcast(known)
    marked = docs.select(key, "_hashes", "_shapes").join(known, key, "left")
    # outer, since the inner form would first evaluate the whole array to filter out empty ones
    rows = marked.select(F.coalesce("_trusted", F.lit(0)).alias("trusted"), F.inline_outer(grams()).alias("h", "s", "g", "t"))
    rows = rows.filter("h is not null")
    both = F.array(_word_bucket(F.col("h"), words), _shape_bucket(*map(F.col, "hsgt"), words, shapes))
    counts = rows.select("trusted", F.explode_outer(both).alias("bucket")).filter("bucket is not null")
    counts = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    every = docs.sparkSession.range(words + shapes).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"]).withColumn("shape", F.col("bucket") >= words)
    size = F.when(F.col("shape"), F.lit(shapes)).otherwise(F.lit(words))
    totals = full.groupBy("shape").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    full = full.join(F.broadcast(totals), "shape")  # two rows
    share = (F.col("raw") + 1.0) / (F.col("all_raw") + size)
    target = (F.col("target") + size * share) / (F.col("all_target") + size)
    return full.select("bucket", F.round(F.log(target / share), 3).alias("weight"))


def trusted_keys(labels: DataFrame, key: str = "doc_id", good: Column | str = "quality = 1", most: int | None = None) -> DataFrame:
    """Distinct keys of all labelled good documents; of about ``most``, chosen by their hash, where that is given."""
    ids = labels.filter(good).filter(F.col(key).isNotNull()).select(key).distinct()
    if most is None or (number := ids.count()) <= most:
        return ids
    return ids.filter(F.pmod(F.xxhash64(F.lit("trusted"), key), F.lit(1 << 30)) < int((1 << 30) * (most / number)))


def assess(
    docs: DataFrame,
    trusted: DataFrame,
    key: str = "doc_id",
    column: str = "text",
    threshold: float = THRESHOLD,
    word_buckets: int = WORD_BUCKETS,
    shape_buckets: int = SHAPE_BUCKETS,
) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed``, ``score`` and ``kept``.

    ``kept`` is false if the base rules fail, else whether the score (log-likelihood ratio
    per word) reaches the threshold. A null text has no words and fails; rows with a null key are
    judged like all others but never trusted. Without trusted documents every score is about
    zero and only the base rules decide. Columns named like the new ones are replaced.
    """
    docs = without(docs, OWN)
    slim = hashed(docs.select(F.col(key), F.col(column)), column)
    model = weights(slim, trusted, key, word_buckets, shape_buckets).orderBy("bucket").collect()  # one row per bucket
    # constant folding turns each text into one array that all rows share
    each = [f"{r['weight']:g}" for r in model]
    of_word, of_shape = (F.split(F.lit(",".join(part)), ",").cast("array<double>") for part in (each[:word_buckets], each[word_buckets:]))

    def add(total: Column, x: Column) -> Column:
        pair = F.get(of_shape, _shape_bucket(x["h"], x["s"], x["g"], x["t"], 0, shape_buckets))
        return total + F.get(of_word, _word_bucket(x["h"], word_buckets)) + F.coalesce(pair, F.lit(0.0))

    scored = base_counts(hashed(docs, column), column)
    total = F.aggregate(grams(), F.lit(0.0), add)
    scored = scored.withColumn("score", total / F.greatest(F.col("n_words"), F.lit(1)))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return scored.withColumn("kept", kept).select(*docs.columns, *COUNTS, "base_failed", "score", "kept")
