"""Queries over ``conversations`` and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.joins import lookup_join
from ..session import materialise
from . import prefix_trie, repair
from .registry import query, table

EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def crc32_sql(column: str) -> str:
    """CRC-32 of a text of ASCII characters; needs ``crc_table`` in scope."""
    return (
        f"xor(list_reduce(list_transform(string_split({column}, ''), lambda ch: ascii(ch)::BIGINT),"
        " lambda acc, b: xor(acc >> 8, crc_table[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    )


CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc_table
)"""


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with the faults of the task, by a hash of each row's id and turn; nulls are one space."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn)), F.lit(20))
    text = F.coalesce("text", space)
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", space))
    rows = turns.filter(kind > 0).select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def _edges_sql() -> str:
    """Every way to take one row: inserts, then a letter, from place to place."""
    rows = []
    for place in range(4):
        for inserts, at in repair._inserts(place):
            audit = "I" * len(inserts)
            cost = repair.COSTS["insert"] * len(inserts)
            lines = "[" + ", ".join("'user:'" if i == "U" else "'assistant:'" for i in inserts) + "]::VARCHAR[]"
            rows.append(f"({place}, {at}, '{audit}D', 'D', '', {cost + repair.COSTS['delete']}, {lines})")
            for role, to in repair.NEXT[at].items():
                rows.append(f"({place}, {to}, '{audit}K', 'K', '{role}', {cost}, {lines})")
                if role != "s":
                    full = "user" if role == "u" else "assistant"
                    rows.append(f"({place}, {to}, '{audit}R', 'R', '{full}', {cost + repair.COSTS['rerole']}, {lines})")
    return ", ".join(rows)


def _ends_sql() -> str:
    rows = []
    for place, inserts in enumerate(repair.ENDS):
        lines = "[" + ", ".join("'user:'" if i == "U" else "'assistant:'" for i in inserts) + "]::VARCHAR[]"
        rows.append(f"({place}, '{'I' * len(inserts)}', {repair.COSTS['insert'] * len(inserts)}, {lines})")
    return ", ".join(rows)


REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE kind > 0
), numbered AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM damaged
), rows AS MATERIALIZED (
  SELECT conv_id, turn, role, text, n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair,
         CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), sums AS (
  SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), edges(source, target, audit, letter, role, cost, lines) AS (VALUES {_edges_sql()}
), ends(source, audit, cost, lines) AS (VALUES {_ends_sql()}
), walk AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS place, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM sums
  UNION ALL
  SELECT conv_id, n, place, cost, audit, lines FROM (
    SELECT w.conv_id, r.n, e.target AS place, w.cost + e.cost + CASE WHEN e.letter <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
           w.audit || e.audit AS audit,
           w.lines || e.lines || CASE e.letter WHEN 'K' THEN [r.role || ':' || r.text] WHEN 'R' THEN [e.role || ':' || r.text] ELSE [] END AS lines
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1
    JOIN edges e ON e.source = w.place
      AND (e.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR e.role = left(r.role, 1)))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, n, place ORDER BY cost, audit) = 1
), best AS (
  SELECT w.conv_id, w.cost + e.cost AS cost, w.audit || e.audit AS audit, w.lines || e.lines AS lines
  FROM walk w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.size = w.n JOIN ends e ON e.source = w.place
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + e.cost, w.audit || e.audit) = 1
)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op12_repair", REPAIR_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    found = repair.repair(damaged(turns))
    names = turns.select("conv_id").distinct()
    audits = found.summary.withColumnRenamed("conv_id", "_conv")
    texts = repair.digests(found.turns).withColumnRenamed("conv_id", "_text")
    joined = names.join(audits, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("_text")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in repair.SUMS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )


MOST_SHARED = 5


def heads(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its hundred."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(MOST_SHARED + 1))


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conversation with its first turns from another one; ``turns`` as of ``prefix_trie.slim_turns``."""
    first = turns.filter(F.col("place") <= MOST_SHARED)
    base = F.col("conv") - F.col("conv") % 100
    wanted = ids.toDF("conv").select("conv", base.alias("base"), heads(F.col("conv")).alias("h"))
    from_base = first.withColumnRenamed("conv", "base")
    taken = wanted.filter("h > 0").join(from_base, "base").filter("place <= h").drop("base", "h")
    have = first.groupBy(F.col("conv").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(have, "base", "left").select("conv", (F.col("h") - F.coalesce("n", F.lit(0))).alias("missing")).filter("missing > 0")
    own = turns.filter(F.col("place") > heads(F.col("conv")))
    own = lookup_join(own, short, "conv").withColumn("place", F.col("place") - F.coalesce("missing", F.lit(0))).drop("missing")
    return taken.unionByName(own)


TRIE_SQL = f"""
WITH {CRC_TABLE}, ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered), crc
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, o.place, o.role, o.text FROM ids i JOIN ordered o ON o.conv_id = i.base AND o.place <= i.h
  UNION ALL
  SELECT i.conv_id, 1, o.place, o.role, o.text FROM ids i JOIN ordered o ON o.conv_id = i.conv_id AND o.place > i.h
), turns AS (
  SELECT conv_id, length(text) AS size, length(role) || ':' || role || text AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth
  FROM rebuilt
), chained AS (
  SELECT conv_id, depth, size, string_agg(md5(turn), '') OVER (PARTITION BY conv_id ORDER BY depth) AS chain FROM turns
), paths AS MATERIALIZED (
  SELECT conv_id, depth, size, md5(chain) AS key, lag(md5(chain), 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM chained
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM ids
), nodes AS MATERIALIZED (
  SELECT depth, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM paths GROUP BY depth, key
), children AS (
  SELECT parent AS key, count(*) AS n FROM nodes GROUP BY parent
), owned AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.key = n.key
), sums AS (
  SELECT p.key, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.size) AS saved_tokens
  FROM owned o JOIN paths p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY p.key
), lengths AS (
  SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), ends AS (
  SELECT p.key, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN lengths l ON l.conv_id = p.conv_id AND l.depth = p.depth
  GROUP BY p.key
)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM owned o JOIN sums s ON s.key = o.key LEFT JOIN nodes u ON u.key = o.parent LEFT JOIN ends e ON e.key = o.key
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    turns = materialise(prefix_trie.slim_turns(rows), "turns")
    ids = rows.select("conv_id").filter("conv_id is not null").distinct()
    return prefix_trie.trie(rebuilt(turns, ids), ids)
