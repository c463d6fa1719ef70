"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, langid, line_dedup, packing, quality, sharding, simhash, token_counts, topk, url_filter
from .registry import query, table

MULTI = "byte_bpe_multi_50k.tiktoken"
PLAIN = "byte_bpe_50k.json"


@query("op2_bpe")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = public_tokenizers.path(MULTI)
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    whole = bpe.decode(coded, path, public_tokenizers.PATTERN)
    return whole.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), placed AS (
  SELECT doc_id, pos, n, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS stop
  FROM counted WHERE n > 0
), spans AS (
  SELECT 0 AS side, doc_id, min(pos) OVER w AS a, max(pos) OVER w AS b, sum(n) OVER w AS words, list(body) OVER w AS body
  FROM (SELECT *, stop - n AS start FROM placed)
  WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT 1, doc_id, min(pos) OVER w, max(pos) OVER w, sum(n) OVER w, list(body) OVER w
  FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY side, body ORDER BY doc_id, a) AS nth FROM spans WHERE words >= 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM numbered WHERE nth > 1
)
SELECT l.doc_id, count(*)::INTEGER AS n_lines, count(g.pos)::INTEGER AS n_deleted,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS kept_md5
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
GROUP BY l.doc_id
"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_deleted", F.md5("text").alias("kept_md5"))


@query("op8_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def digest(pieces: DataFrame) -> DataFrame:
        return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

    found = packing.pack(docs, public_tokenizers.path(PLAIN), digest=digest, special=True)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_simhash")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_quality")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    trusted = quality.trusted_keys(table(spark, sf, "labels"), good="quality = 1 and toxic = 0")
    return quality.assess(docs, trusted).select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def held_out():
    """A quarter of the documents that no language model learns from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


@query("op4_language")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.filter(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op1_ann")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = token_counts.masking_edits(table(spark, sf, "documents").select("doc_id", "text"))
    return token_counts.count_edits(docs, public_tokenizers.path(MULTI), public_tokenizers.PATTERN)


SHARDS = [f"shard-{i:02d}" for i in range(64)]


def shards_sql() -> str:
    """Placement over the lookup table, written out as two digits a slot."""
    owner = "".join(f"{o:02d}" for o in sharding.lookup_table(SHARDS).tolist())
    return f"""
WITH hashed AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS})::INTEGER AS slot FROM documents
)
SELECT doc_id, slot, 'shard-' || substr('{owner}', slot * 2 + 1, 2) AS shard FROM hashed
"""


@query("op7_sharding", shards_sql())
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents").select("doc_id"), SHARDS)


# The rules of the task.
URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


def url_sql() -> str:
    """Every rule as a case, longest first."""
    cases = ""
    for verdict, host, path in sorted(map(url_filter.parse, URL_RULES), key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases += f"WHEN {fits} THEN {{'rule': '{host}{path}', 'verdict': '{verdict}'}} "
    return rf"""
WITH rests AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM rests
), parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM hosts
), judged AS (
  SELECT *, CASE {cases} ELSE {{'rule': NULL, 'verdict': '{url_filter.DEFAULT}'}} END AS found FROM parts
)
SELECT page_id, host, path, found.rule AS rule, found.verdict AS verdict FROM judged
"""


@query("op9_url_filter", url_sql())
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages").select("page_id", "url"), URL_RULES).drop("url")


TOP_SQL = """
WITH numbers AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score
  FROM numbers q JOIN numbers c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.z) = len(c.z)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op13_topk", TOP_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_products(vectors, vectors.filter("vec_id % 100 = 0"))
