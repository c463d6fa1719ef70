"""Trees and forests with exact cuts against chained SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.classify import REGISTRY, ModelSpec, decision_tree
from ..models.kmeans import HALF, PRIME, draw_factors
from ..models.trees import DIGITS, DRAWN, Forest, root_name
from ..plans.evaluation import model_matrix
from .base import query, table
from .machines import machine_sql

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["A", "N", "R"]


def drawn_sql(seed: int, tree: int, key: str) -> str:
    """How often a tree draws a row."""
    h0, h1 = (f"('0x' || substr(md5(({key})::VARCHAR), {1 + a}, {HALF}))::BIGINT % {PRIME}" for a in (0, HALF))
    f0, f1 = draw_factors(seed, tree)
    share = f"(({h0}) * {f0} % {PRIME} + ((({h1}) * {f1} % {PRIME})::DOUBLE + 0.5::DOUBLE) / {PRIME}::DOUBLE) / {PRIME}::DOUBLE"
    return f"len(list_filter([{', '.join(f'{float(t)!r}::DOUBLE' for t in DRAWN)}], lambda t: t <= {share}))"


def trees_sql(rows: str, width: int, classes: int, depth: int, seed: int, weights: list[str], tried: int, digits: int = 9) -> str:
    """All nodes of trees grown level by level; ``rows`` gives x0, x1, …, y and what the weights are made of."""
    xs, cs = [f"x{f}" for f in range(width)], [f"c{k}" for k in range(classes)]
    each = " UNION ALL ".join(
        f"SELECT {t} AS tree, '{root_name(seed, t)}' AS node, {', '.join(xs)}, y, {w} AS w FROM d" for t, w in enumerate(weights)
    )
    ctes = [f"d AS MATERIALIZED ({rows})", f"r0 AS MATERIALIZED (SELECT * FROM ({each}) WHERE w > 0)"]
    out = []
    counts = ", ".join(f"coalesce(sum(w) FILTER (y = {k}), 0)::DOUBLE AS c{k}" for k in range(classes))
    for level in range(depth + 1):
        ctes.append(f"n{level} AS MATERIALIZED (SELECT tree, node, {counts} FROM r{level} GROUP BY tree, node)")
        if level == depth:
            split, join = "NULL::BIGINT AS feature, NULL::DOUBLE AS border", ""
        else:
            wide = " UNION ALL ".join(f"SELECT tree, node, {f} AS f, x{f} AS x, y, w FROM r{level}" for f in range(width))
            ctes.append(f"v{level} AS (SELECT tree, node, f, x, {counts} FROM ({wide}) GROUP BY tree, node, f, x)")
            sums = ", ".join(f"sum({c}) OVER w AS l{c}, sum({c}) OVER (PARTITION BY tree, node, f) - sum({c}) OVER w AS r{c}" for c in cs)
            ctes.append(
                f"s{level} AS (SELECT tree, node, f, x, lead(x) OVER w AS nx, {sums} FROM v{level} WINDOW w AS (PARTITION BY tree, node, f ORDER BY x))"
            )
            n, q = ({s: " + ".join(f"{s}{c}{'*' + s + c if square else ''}" for c in cs) for s in "lr"} for square in (False, True))
            score = f"(({n['l']}) - ({q['l']}) / ({n['l']}) + ({n['r']}) - ({q['r']}) / ({n['r']})) / ({n['l']} + {n['r']})"
            ctes.append(
                f"o{level} AS (SELECT tree, node, f, row_number() OVER (PARTITION BY tree, node ORDER BY md5(node || ':' || f)) AS place"
                f" FROM (SELECT tree, node, f FROM v{level} GROUP BY tree, node, f HAVING count(*) > 1))"
            )
            impure = " + ".join(f"(m.{c} > 0)::INT" for c in cs)
            ctes.append(
                f"p{level} AS MATERIALIZED (SELECT tree, node, f AS feature, x + (nx - x) / 2 AS border FROM s{level} JOIN o{level} USING (tree, node, f)"
                f" JOIN n{level} m USING (tree, node) WHERE nx IS NOT NULL AND place <= {tried} AND {impure} > 1"
                f" QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY round({score}, {DIGITS}), f, x) = 1)"
            )
            side = "CASE " + " ".join(f"WHEN feature = {f} THEN x{f}" for f in range(width)) + " END <= border"
            ctes.append(
                f"r{level + 1} AS MATERIALIZED (SELECT tree, md5(node || CASE WHEN {side} THEN 'L' ELSE 'R' END) AS node, {', '.join(xs)}, y, w"
                f" FROM r{level} JOIN p{level} USING (tree, node))"
            )
            split, join = "p.feature::BIGINT AS feature, p.border", f"LEFT JOIN p{level} p USING (tree, node)"
        out.append(f"SELECT tree::BIGINT AS tree, {level}::BIGINT AS depth, node AS name, {split}, {', '.join(cs)} FROM n{level} {join}")
    return "WITH " + ",\n".join(ctes) + "\nSELECT tree, depth, name, feature, round(border, {digits}) AS border, ".format(digits=digits) + ", ".join(cs) + " FROM (" + " UNION ALL ".join(out) + ")"


LINES_SQL = (
    "SELECT l_orderkey * 10 + l_linenumber AS id, "
    + ", ".join(f"{c}::DOUBLE AS x{i}" for i, c in enumerate(FEATURES))
    + f", list_position({FLAGS}, l_returnflag) - 1 AS y FROM lineitem"
)


def lines(spark, sf):
    point = F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("features")
    flag = (F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.col("l_returnflag")) - 1).cast("int").alias("label")
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), point, flag)


def node_rows(model, classes: int):
    """One row per node with a column of weight per class."""
    weights = [F.coalesce(F.get("n", F.array_position("cls", F.lit(k)).cast("int") - 1), F.lit(0.0)).alias(f"c{k}") for k in range(classes)]
    return model.nodes().select("tree", "depth", "name", "feature", F.round("border", 9).alias("border"), *weights)


@query("m06d_tree_exact_cuts", trees_sql(LINES_SQL, 4, 3, 2, 42, ["1"], 4))
def m06d(spark, sf):
    """A tree of two levels over all lines."""
    return node_rows(Forest(classes=3, max_depth=2).fit(lines(spark, sf)), 3)


@query("m07b_forest_exact_cuts", trees_sql(LINES_SQL, 4, 3, 2, 7, [drawn_sql(7, t, "id") for t in range(2)], 2))
def m07b(spark, sf):
    """Two trees of two levels on drawn rows, two drawn features a node."""
    forest = Forest(classes=3, trees=2, tried=2, max_depth=2, seed=7, bootstrap=True, key="id")
    return node_rows(forest.fit(lines(spark, sf)), 3)


def matrix_sql(depth: int = 3, seed: int = 42) -> str:
    """A hold-out split, its scaler, a machine and a tree on the train part, both judged on the test part."""
    place = f"row_number() OVER (ORDER BY substr(md5('{seed}:' || p_partkey), 1, 15), p_partkey) <= ceil(0.2::DOUBLE * count(*) OVER ())"
    machine = machine_sql("SELECT z0 AS x1, z1 AS x2, label FROM scaled WHERE NOT test", [1], digits=12)
    tree = trees_sql("SELECT id, x0, x1, label AS y FROM scaled WHERE NOT test", 2, 2, depth, seed, ["1"], 2, digits=15)
    weights = ", ".join(f"max(value) FILTER (b = '{t}') AS w{k}" for k, t in enumerate(("first", "second", "constant")))
    steps = [f"q0 AS (SELECT id, label, x0, x1, '{root_name(seed, 0)}' AS node FROM scaled WHERE test)"]
    for k in range(depth):
        side = "CASE WHEN CASE WHEN feature = 0 THEN x0 ELSE x1 END <= border THEN 'L' ELSE 'R' END"
        steps.append(
            f"q{k + 1} AS (SELECT id, label, x0, x1, CASE WHEN feature IS NULL THEN node ELSE md5(node || {side}) END AS node FROM q{k} JOIN t ON t.name = node)"
        )
    return f"""WITH points AS (
  SELECT p_partkey AS id, p_size / 50 AS x0, (p_retailprice - 900) / 1000 AS x1,
         CASE WHEN p_size / 50 + (p_retailprice - 900) / 1000 + (p_partkey % 7) / 20 > 1.2 THEN 1 ELSE 0 END AS label, {place} AS test FROM part
), ranges AS (
  SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1 FROM points WHERE NOT test
), scaled AS MATERIALIZED (
  SELECT id, x0, x1, label, test, (x0 - m0) / s0 AS z0, (x1 - m1) / s1 AS z1 FROM points, ranges
), w AS (SELECT {weights} FROM ({machine}) WHERE kind = 'weight'
), t AS MATERIALIZED ({tree}
), {", ".join(steps)}, judged AS (
  SELECT 'LinearSVC' AS algorithm, 'scaled' AS feature_set, label, CASE WHEN w0 * z0 + w1 * z1 + w2 > 0 THEN 1 ELSE 0 END AS found FROM scaled, w WHERE test
  UNION ALL SELECT 'Decision Tree', 'raw', label, CASE WHEN c1 > c0 THEN 1 ELSE 0 END FROM q{depth} JOIN t ON t.name = node
), recalls AS (
  SELECT algorithm, feature_set, label, count(*) AS n, count(*) FILTER (found = label) AS hits FROM judged GROUP BY ALL
)
SELECT algorithm, feature_set, (SELECT count(*) FROM scaled WHERE NOT test) AS n_train, sum(n)::BIGINT AS n_test, sum(hits)::BIGINT AS correct,
       round(sum(hits) / sum(n), 9) AS accuracy, round(avg(hits / n), 9) AS balanced_accuracy FROM recalls GROUP BY ALL"""


@query("p01b_model_matrix_exact", matrix_sql())
def p01b(spark, sf):
    """Hold-out quality of two models with one answer, blurred classes."""
    x0, x1 = F.col("p_size") / 50, (F.col("p_retailprice") - 900) / 1000
    label = F.when(x0 + x1 + (F.col("p_partkey") % 7) / 20 > 1.2, 1).otherwise(0).alias("label")
    parts = table(spark, sf, "part").select("p_partkey", x0.alias("x0"), x1.alias("x1"), label)
    tree = ModelSpec("Decision Tree", "raw", lambda d, k, seed, x, y: decision_tree(x, y, 3, seed, k))
    found = model_matrix(parts, "p_partkey", ["x0", "x1"], "label", {"LinearSVC": REGISTRY["LinearSVC"], "Decision Tree": tree})
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "balanced_accuracy")})
