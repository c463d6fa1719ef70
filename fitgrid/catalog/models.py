"""Model training. Closed forms have SQL; trained models report hold-out quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import classify
from ..models.classify import REGISTRY, ModelSpec
from ..models.gini import gini_root_split
from ..models.kernel import rbf_features, rbf_kernel, rbf_weights
from ..models.kmeans import HALF, PRIME, _key_halves, draw_factors, fit_kmeans_best_of, lloyd, oversampled_candidates
from ..models.linear import fit_ols, ols_1d
from ..operators.metrics import r2
from ..operators.split import random_split
from ..operators.stats import sample_stats
from ..plans.evaluation import MATRIX, fit_spec, hold_out, model_matrix, quality, repeated_runs
from .base import query, table
from .documents import LANGUAGE_FEATURES, QUALITY_FEATURES, language_table, quality_table
from .quality import CENTRES_SQL, first_centres


@query(
    "m01_linreg_1d",
    """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 9) AS r2
FROM lineitem GROUP BY l_returnflag""",
)
def m01_1d(spark, sf):
    out = ols_1d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select(
        "l_returnflag",
        F.round("slope", 4).alias("slope"),
        F.round("intercept", 4).alias("intercept"),
        F.round("r2", 9).alias("r2"),
    )


def _cramer_sql() -> str:
    x = ["l_quantity", "l_discount", "l_tax"]
    a = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    y = ["y0", "y1", "y2"]

    def det(m):
        return (
            f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]})"
            f"-{m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})"
            f"+{m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"
        )

    moments = [f"covar_pop({x[i]}, {x[j]}) AS c{i}{j}" for i in range(3) for j in range(i, 3)]
    moments += [f"covar_pop({x[i]}, l_extendedprice) AS y{i}" for i in range(3)]
    moments += [f"avg({c}) AS m{i}" for i, c in enumerate(x)] + ["avg(l_extendedprice) AS my"]
    betas = []
    for k in range(3):
        swapped = [[y[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]
        betas.append(f"{det(swapped)} / {det(a)} AS b{k}")
    terms = [f"SELECT '{c}' AS term, round(b{i}, 3) + 0.0::DOUBLE AS value FROM b" for i, c in enumerate(x)]
    terms.append("SELECT 'intercept', round(my - b0*m0 - b1*m1 - b2*m2, 3) FROM b")
    return (
        f"WITH m AS (SELECT {', '.join(moments)} FROM lineitem),\n"
        f"b AS (SELECT *, {', '.join(betas)} FROM m)\n" + "\nUNION ALL\n".join(terms)
    )


@query("m01_linreg_3d", _cramer_sql())
def m01_3d(spark, sf):
    model = fit_ols(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    rows = [*zip(model.features, model.coefficients), ("intercept", model.intercept)]
    return spark.createDataFrame(rows, "term string, value double").withColumn("value", F.round("value", 3))


def one_model(spark, df, features, spec: ModelSpec):
    return model_matrix(df, "doc_id", features, "label", {spec.name: spec})


@query("m02_svm_linear_ovr")
def m02(spark, sf):
    spec = ModelSpec("SVC (linear)", "scaled", lambda d, k, seed, x, y: classify.linear_svc(x, y, k))
    return one_model(spark, language_table(spark, sf), LANGUAGE_FEATURES, spec)


@query("m03_linear_svc")
def m03(spark, sf):
    return one_model(spark, quality_table(spark, sf), QUALITY_FEATURES, REGISTRY["LinearSVC"])


@query(
    "m04a_rbf_kernel",
    """WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, list(v ORDER BY pos) AS z FROM (SELECT label, pos, avg(v) AS v FROM u GROUP BY label, pos) GROUP BY label)
SELECT vec_id, c.label AS landmark,
       round(exp(-0.5::DOUBLE * list_distance(embedding::DOUBLE[], z) * list_distance(embedding::DOUBLE[], z)), 6) AS kernel
FROM embeddings e CROSS JOIN c""",
)
def m04a(spark, sf):
    vectors = table(spark, sf, "embeddings")
    width = len(vectors.select("embedding").first()[0])
    means = vectors.groupBy("label").agg(
        F.array(*[F.avg(F.col("embedding")[j].cast("double")) for j in range(width)]).alias("z")
    )
    landmarks = [(r["label"], r["z"]) for r in means.orderBy("label").collect()]
    out = rbf_kernel(vectors, "embedding", landmarks, 0.5, ["vec_id"])
    return out.withColumn("kernel", F.round("kernel", 6))


def _random_feature_sql(n: int, gamma: float, seed: int) -> str:
    weights, phases = rbf_weights(2, n, gamma, seed)
    columns = ["p_size / 50", "p_retailprice / 1000"]
    each = []
    for j in range(n):
        terms = [f"({float(w)!r})::DOUBLE * ({c})" for w, c in zip(weights[:, j], columns)]
        angle = " + ".join([*terms, f"({float(phases[j])!r})::DOUBLE"])
        each.append(f"round(sqrt(2.0::DOUBLE / {n}) * cos({angle}), 6) + 0.0::DOUBLE AS z{j}")
    return f"SELECT p_partkey, {', '.join(each)} FROM part"


@query("m04c_random_features", _random_feature_sql(6, 0.5, 42))
def m04c(spark, sf):
    point = F.array(F.col("p_size") / 50, F.col("p_retailprice") / 1000).alias("x")
    parts = table(spark, sf, "part").select("p_partkey", point)
    mapped = rbf_features(parts, "x", 0.5, 6, 42, out="z")
    return mapped.select("p_partkey", *[F.round(F.get("z", F.lit(j)), 6).alias(f"z{j}") for j in range(6)])


@query("m04b_rbf_svm")
def m04b(spark, sf):
    return one_model(spark, quality_table(spark, sf), QUALITY_FEATURES, REGISTRY["SVC"])


@query("m05_rbf_svm_ovr")
def m05(spark, sf):
    """Kernel machine for four classes, by largest margin and by hard votes."""
    spec = REGISTRY["SVC"]
    with hold_out(language_table(spark, sf), "doc_id", LANGUAGE_FEATURES, "label") as data:
        pipeline = fit_spec(data, spec)
        mapped, model = pipeline.stages
        features = mapped.transform(data.test)
        rows = []
        for vote in ("margin", "hard"):
            predicted = model.with_vote(vote).transform(features)
            rows.append((f"SVC ({vote})", spec.features, data.n_train, data.n_test, *quality(predicted)))
    return spark.createDataFrame(rows, MATRIX)


def _gini_sql() -> str:
    return """WITH f AS (
  SELECT 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS x, quality AS y FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'space_share', (length(text) - length(replace(text, ' ', ''))) / greatest(length(text), 1)::DOUBLE, quality
  FROM documents JOIN labels USING (doc_id)),
v AS (SELECT feature, x, count(*) FILTER (WHERE y = 0) AS c0, count(*) FILTER (WHERE y = 1) AS c1 FROM f GROUP BY 1, 2),
r AS (SELECT feature, x, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1,
             sum(c0) OVER (PARTITION BY feature) - sum(c0) OVER w AS r0,
             sum(c1) OVER (PARTITION BY feature) - sum(c1) OVER w AS r1
      FROM v WINDOW w AS (PARTITION BY feature ORDER BY x)),
g AS (SELECT feature, x, l0 + l1 AS n_left, r0 + r1 AS n_right,
             ((l0 + l1) - (l0 * l0 + l1 * l1) / (l0 + l1)::DOUBLE + (r0 + r1) - (r0 * r0 + r1 * r1) / (r0 + r1)::DOUBLE)
             / (l0 + l1 + r0 + r1) AS impurity
      FROM r WHERE r0 + r1 > 0)
SELECT feature, round(x, 9) AS threshold, round(impurity, 9) AS impurity,
       CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right
FROM g QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(impurity, 12), x) = 1"""


@query("m06a_gini_root_split", _gini_sql())
def m06a(spark, sf):
    text, size = F.col("text"), F.greatest(F.length("text"), F.lit(1)).cast("double")
    docs = table(spark, sf, "documents").select(
        "doc_id", "n_chars", ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / size).alias("space_share")
    )
    labelled = docs.join(table(spark, sf, "labels"), "doc_id")
    best = gini_root_split(labelled, ["n_chars", "space_share"], "quality")
    return best.withColumns({"threshold": F.round("threshold", 9), "impurity": F.round("impurity", 9)})


@query("m06b_decision_tree")
def m06b(spark, sf):
    return one_model(spark, quality_table(spark, sf), QUALITY_FEATURES, REGISTRY["DecisionTreeClassifier"])


@query("m06c_decision_tree_depth_10")
def m06c(spark, sf):
    spec = ModelSpec("Decision Tree", "raw", lambda d, k, seed, x, y: classify.decision_tree(x, y, max_depth=10, seed=seed, classes=k))
    return one_model(spark, quality_table(spark, sf), QUALITY_FEATURES, spec)


@query("m07_random_forest")
def m07(spark, sf):
    return one_model(spark, quality_table(spark, sf), QUALITY_FEATURES, REGISTRY["RandomForestClassifier"])


@query("m08_mlp")
def m08(spark, sf):
    return one_model(spark, quality_table(spark, sf), QUALITY_FEATURES, REGISTRY["MLPClassifier"])


def _lloyd_sql(rounds: int) -> str:
    ctes = [CENTRES_SQL]
    for i in range(rounds):
        ctes.append(
            f"a{i} AS (SELECT vec_id, any_value(x) AS x, arg_min(cluster, list_distance(x, c)) AS cluster "
            f"FROM e, c{i} GROUP BY vec_id),\n"
            f"u{i} AS (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}),\n"
            f"c{i + 1} AS (SELECT cluster, list(v ORDER BY pos) AS c FROM "
            f"(SELECT cluster, pos, avg(v) AS v FROM u{i} GROUP BY cluster, pos) GROUP BY cluster)"
        )
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT CAST(cluster AS INTEGER) AS cluster, CAST(pos - 1 AS INTEGER) AS pos, "
        f"round(v, 4) + 0.0::DOUBLE AS value FROM (SELECT cluster, unnest(c) AS v, generate_subscripts(c, 1) AS pos FROM c{rounds})"
    )


@query("m09a_kmeans_lloyd", _lloyd_sql(5))
def m09a(spark, sf):
    centres = lloyd(table(spark, sf, "embeddings"), "embedding", first_centres(spark, sf), 5)
    return centres.frame(spark).withColumn("value", F.round("value", 4))


@query("m09b_kmeans_best_of")
def m09b(spark, sf):
    best = fit_kmeans_best_of(table(spark, sf, "embeddings"), "embedding", 8, key="vec_id")
    rows = [(seed, cost, seed == best.seed) for seed, cost in best.costs.items()]
    return spark.createDataFrame(rows, "seed int, cost double, chosen boolean")


def _two_starts_sql(seeds: tuple[int, ...], k: int, rounds: int) -> str:
    """The drawn starts and the rounds after them as chained tables; centres are rows of lists."""
    ctes = [
        f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS x,
  ('0x' || substr(md5(vec_id::VARCHAR), 1, {HALF}))::BIGINT % {PRIME} AS h0,
  ('0x' || substr(md5(vec_id::VARCHAR), {HALF + 1}, {HALF}))::BIGINT % {PRIME} AS h1 FROM embeddings)"""
    ]
    ends = []
    for seed in seeds:
        for turn in range(k):
            f0, f1 = draw_factors(seed, turn)
            name, chosen = f"s{seed}_{turn}", " UNION ALL ".join(f"SELECT {t} AS cluster, c FROM s{seed}_{t}" for t in range(turn))
            weight = f"(SELECT min(list_distance(x, c)) ** 2 FROM ({chosen}))" if turn else "1.0::DOUBLE"
            share = f"(h0 * {f0} % {PRIME} + ((h1 * {f1} % {PRIME})::DOUBLE + 0.5::DOUBLE) / {PRIME}::DOUBLE) / {PRIME}::DOUBLE"
            ctes.append(f"{name} AS (SELECT arg_min(x, time) AS c FROM (SELECT x, -ln({share}) / {weight} AS time FROM e))")
        ctes.append(f"k{seed}_0 AS (" + " UNION ALL ".join(f"SELECT {t} AS cluster, c FROM s{seed}_{t}" for t in range(k)) + ")")
        for i in range(rounds + 1):
            near = f"SELECT vec_id, any_value(x) AS x, arg_min(cluster, list_distance(x, c)) AS cluster, min(list_distance(x, c)) AS far FROM e, k{seed}_{i} GROUP BY vec_id"
            ctes.append(f"a{seed}_{i} AS ({near})")
            ctes.append(f"u{seed}_{i} AS (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{seed}_{i})")
            means = f"SELECT cluster, pos, avg(v) AS v FROM u{seed}_{i} GROUP BY cluster, pos"
            ctes.append(f"k{seed}_{i + 1} AS (SELECT cluster, list(v ORDER BY pos) AS c FROM ({means}) GROUP BY cluster)")
        ends.append(f"SELECT {seed} AS seed, round(sum(far * far), 4) AS cost FROM a{seed}_{rounds}")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(ends)


@query("m09c_kmeans_drawn_starts", _two_starts_sql((0, 1), 3, 2))
def m09c(spark, sf):
    """Starts drawn over all rows and two rounds after them."""
    best = fit_kmeans_best_of(table(spark, sf, "embeddings"), "embedding", 3, seeds=(0, 1), max_iter=2, tol=0.0, key="vec_id")
    out = spark.createDataFrame(list(best.costs.items()), "seed int, cost double")
    return out.withColumn("cost", F.round("cost", 4))


def _rounds_sql(seeds: tuple[int, ...], k: int, rounds: int) -> str:
    """Candidates of oversampling rounds as chained tables, with the rows nearest to each."""
    ctes = [
        f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS x,
  ('0x' || substr(md5(vec_id::VARCHAR), 1, {HALF}))::BIGINT % {PRIME} AS h0,
  ('0x' || substr(md5(vec_id::VARCHAR), {HALF + 1}, {HALF}))::BIGINT % {PRIME} AS h1 FROM embeddings)"""
    ]
    ends = []
    for seed in seeds:
        def share(turn):
            f0, f1 = draw_factors(seed, turn)
            return f"(h0 * {f0} % {PRIME} + ((h1 * {f1} % {PRIME})::DOUBLE + 0.5::DOUBLE) / {PRIME}::DOUBLE) / {PRIME}::DOUBLE"

        ctes.append(f"c{seed}_0 AS (SELECT 0 AS turn, arg_min(x, -ln({share(0)})) AS c FROM e)")
        for turn in range(1, rounds + 1):
            far = f"SELECT vec_id, any_value(x) AS x, any_value(h0) AS h0, any_value(h1) AS h1, min(list_distance(x, c)) ** 2 AS far FROM e, c{seed}_{turn - 1} GROUP BY vec_id"
            ctes.append(f"f{seed}_{turn} AS MATERIALIZED ({far})")
            ctes.append(
                f"c{seed}_{turn} AS MATERIALIZED (SELECT * FROM c{seed}_{turn - 1} UNION ALL SELECT {turn}, x FROM f{seed}_{turn}"
                f" WHERE {share(turn)} < {2.0 * k}::DOUBLE / (SELECT sum(far) FROM f{seed}_{turn}) * far)"
            )
        near = f"SELECT vec_id, arg_min(c, (list_distance(x, c), turn, c)) AS c FROM e, c{seed}_{rounds} GROUP BY vec_id"
        sizes = f"SELECT c, count(*) AS n FROM ({near}) GROUP BY c"
        ends.append(f"SELECT {seed} AS seed, turn, round(c[1], 9) AS first, coalesce(n, 0) AS n FROM c{seed}_{rounds} LEFT JOIN ({sizes}) USING (c)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT seed, first, n::BIGINT AS n FROM (" + " UNION ALL ".join(ends) + ")"


@query("m09d_kmeans_rounds", _rounds_sql((0, 1), 6, 2))
def m09d(spark, sf):
    """Candidate centres of two oversampling rounds and the rows nearest to each."""
    data = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), *_key_halves(F.col("vec_id")))
    found = oversampled_candidates(data, 6, (0, 1), rounds=2)
    rows = [(seed, round(float(c[0]), 9), int(n)) for seed, (candidates, sizes) in enumerate(found) for c, n in zip(candidates, sizes)]
    return spark.createDataFrame(rows, "seed int, first double, n bigint")


@query("p01_model_matrix")
def p01(spark, sf):
    return model_matrix(quality_table(spark, sf), "doc_id", QUALITY_FEATURES, "label")


@query("p02_repeated_runs")
def p02(spark, sf):
    """Tree accuracy over five seeds after one warmup run."""
    spec = REGISTRY["DecisionTreeClassifier"]
    return repeated_runs(quality_table(spark, sf), "doc_id", QUALITY_FEATURES, "label", spec, range(6), warmup=1)


def _runs_sql(seeds: tuple[int, ...]) -> str:
    ctes, scores = [], []
    for s in seeds:
        place = f"row_number() OVER (ORDER BY substr(md5('{s}:' || o_orderkey), 1, 15), o_orderkey) <= ceil(0.2::DOUBLE * count(*) OVER ())"
        ctes.append(f"d{s} AS (SELECT o_totalprice AS y, o_custkey::DOUBLE AS x, {place} AS test FROM orders)")
        ctes.append(f"f{s} AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d{s} WHERE NOT test)")
        scores.append(f"SELECT 1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2 FROM d{s}, f{s} WHERE test")
    return (
        "WITH " + ",\n".join(ctes) + f",\nr AS ({' UNION ALL '.join(scores)})\n"
        "SELECT round(avg(r2), 9) + 0.0::DOUBLE AS mean, round(stddev_samp(r2), 9) AS std_dev, round(min(r2), 9) + 0.0::DOUBLE AS \"min\", "
        "round(max(r2), 9) + 0.0::DOUBLE AS \"max\", count(*) AS count FROM r"
    )


@query("p03_least_squares_runs", _runs_sql((1, 2, 3)))
def p03(spark, sf):
    """Quality of least squares over three seeds after one warmup run, each on its own split."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    scores = []
    for seed in range(4):
        split = random_split(orders, "o_orderkey", 0.2, seed)
        model = fit_ols(split.filter("part = 'train'"), ["o_custkey"], "o_totalprice")
        scores.append((seed, r2(model.transform(split.filter("part = 'test'")), "o_totalprice", "prediction").first()[0]))
    runs = spark.createDataFrame(scores, "seed int, r2 double").filter("seed >= 1")
    found = sample_stats(runs, [], "r2")
    return found.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("mean", "std_dev", "min", "max")})
