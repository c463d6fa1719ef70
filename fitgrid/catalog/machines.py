"""Trained machines whose optimum is unique, and a perceptron with given weights, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import mlp
from ..models.classify import mlp_forward
from ..models.kernel import rbf_features, rbf_weights
from ..models.kmeans import HALF, PRIME
from ..models.svm import LinearMachine
from .base import query, table

ROUNDS = 14
TERMS = ["first", "second", "constant"]


def det(m) -> str:
    return (
        f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]})"
        f"-{m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})"
        f"+{m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"
    )


def machine_sql(rows: str, classes: list, pairs: bool = False, digits: int = 4) -> str:
    """Squared hinge machines over ``x1, x2, label``: each round solves for the rows inside the margin.

    ``rows`` is a query; the rounds end at the minimum, where the set of those rows no longer changes.
    ``classes`` have a machine each, or with ``pairs`` are what a machine tells from each other.
    """
    gram = [["1+2*g11", "2*g12", "2*g1"], ["2*g12", "1+2*g22", "2*g2"], ["2*g1", "2*g2", "1+2*n"]]
    gram = [[f"({c})" for c in row] for row in gram]
    right = ["(2*t1)", "(2*t2)", "(2*t0)"]
    solved = []
    for k in range(3):
        swapped = [[right[i] if j == k else gram[i][j] for j in range(3)] for i in range(3)]
        solved.append(f"{det(swapped)} / {det(gram)} AS w{k}")
    names = classes if not pairs else [f"{i} AS cls, {a} AS yes, {b}" for i, (a, b) in enumerate(classes)]
    sides = " UNION ALL ".join(f"SELECT {c} AS {'cls' if not pairs else 'no'}" for c in names)
    positive, seen = ("yes", "WHERE label IN (yes, no)") if pairs else ("cls", "")
    ctes = [
        f"d AS MATERIALIZED ({rows})",
        f"c AS ({sides})",
        f"r AS MATERIALIZED (SELECT cls, x1, x2, label, CASE WHEN label = {positive} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM d, c {seen})",
        "m0 AS (SELECT cls, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM c)",
    ]
    for i in range(ROUNDS):
        ctes.append(
            f"s{i} AS MATERIALIZED (SELECT cls, sum(x1*x1) AS g11, sum(x1*x2) AS g12, sum(x1) AS g1, sum(x2*x2) AS g22, sum(x2) AS g2,"
            f" count(*)::DOUBLE AS n, sum(y*x1) AS t1, sum(y*x2) AS t2, sum(y) AS t0"
            f" FROM r JOIN m{i} USING (cls) WHERE y * (w0*x1 + w1*x2 + w2) < 1 GROUP BY cls)"
        )
        ctes.append(f"m{i + 1} AS MATERIALIZED (SELECT cls, {', '.join(solved)} FROM s{i})")
    last = f"m{ROUNDS}"
    parts = [f"SELECT 'weight' AS kind, cls AS a, '{t}' AS b, round(w{k}, {digits}) + 0.0::DOUBLE AS value FROM {last}" for k, t in enumerate(TERMS)]
    score = " ".join(["f AS (SELECT d.*, cls, w0*x1 + w1*x2 + w2 AS f FROM d,", f"{last}),"])
    if pairs:
        wins = "SELECT id, label, CASE WHEN f > 0 THEN yes ELSE no END AS win, count(*) AS n FROM f JOIN c USING (cls) GROUP BY id, label, win"
        best = f"v AS (SELECT label, win FROM ({wins}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, win) = 1)"
        parts.append("SELECT 'pairs', label, CAST(win AS VARCHAR), count(*)::DOUBLE FROM v GROUP BY label, win")
        return "WITH " + ",\n".join(ctes) + f",\n{score}\n{best}\n" + "\nUNION ALL\n".join(parts)
    votes = (
        "v AS (SELECT any_value(label) AS label, arg_max(cls, f) AS by_margin, coalesce(min(cls) FILTER (f > 0), 0) AS by_hand FROM f GROUP BY id)"
        if len(classes) > 1
        else f"v AS (SELECT label, CASE WHEN f > 0 THEN {classes[0]} ELSE 0 END AS by_margin FROM f)"
    )
    for kind, column in (("margin", "by_margin"), ("hard", "by_hand"))[: 1 + (len(classes) > 1)]:
        parts.append(f"SELECT '{kind}', label, CAST({column} AS VARCHAR), count(*)::DOUBLE FROM v GROUP BY label, {column}")
    return "WITH " + ",\n".join(ctes) + f",\n{score}\n{votes}\n" + "\nUNION ALL\n".join(parts)


def machine_rows(spark, df, classes: int, votes: tuple[str, ...] = (), **how):
    """Weights, and how many rows of each label each vote gives to each class."""
    votes = votes or ("margin", "hard")[: 1 + (classes > 2)]
    model = LinearMachine("x", "label", classes, vote=votes[0], **how).fit(df)
    names = [1] if classes == 2 else list(range(len(model.weights)))
    rows = [("weight", c, t, round(float(w), 4) + 0.0) for c, ws in zip(names, model.weights) for t, w in zip(TERMS, ws)]
    out = spark.createDataFrame(rows, "kind string, a int, b string, value double")
    for kind in votes:
        counted = model.with_vote(kind).transform(df).groupBy("label", "prediction").agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(
            counted.select(F.lit(kind).alias("kind"), F.col("label").cast("int").alias("a"), F.col("prediction").cast("int").cast("string").alias("b"), "value")
        )
    return out


# Quantity decides the class, the tax blurs it.
TWO_SQL = "SELECT l_quantity / 50 AS x1, l_discount * 10 AS x2, CASE WHEN l_quantity / 50 + l_tax * 5 > 0.7 THEN 1 ELSE 0 END AS label FROM lineitem"


@query("m03b_linear_machine", machine_sql(TWO_SQL, [1]))
def m03b(spark, sf):
    lines = table(spark, sf, "lineitem")
    blurred = F.col("l_quantity") / 50 + F.col("l_tax") * 5
    label = F.when(blurred > 0.7, 1).otherwise(0).alias("label")
    return machine_rows(spark, lines.select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("x"), label), 2)


THREE_SQL = """SELECT row_number() OVER () AS id, x1, x2, CASE WHEN x1 + x2 < 0.7 THEN 0 WHEN x1 - x2 > 0.3 THEN 1 ELSE 2 END AS label
FROM (SELECT p_size / 50 AS x1, (p_retailprice - 900) / 1000 AS x2 FROM part)"""


def three_classes(spark, sf):
    x1, x2 = F.col("p_size") / 50, (F.col("p_retailprice") - 900) / 1000
    label = F.when(x1 + x2 < 0.7, 0).when(x1 - x2 > 0.3, 1).otherwise(2).alias("label")
    return table(spark, sf, "part").select(F.array(x1, x2).alias("x"), label)


@query("m02b_machines_ovr", machine_sql(THREE_SQL, [0, 1, 2]))
def m02b(spark, sf):
    return machine_rows(spark, three_classes(spark, sf), 3)


@query("m02c_machines_of_pairs", machine_sql(THREE_SQL, [(0, 1), (0, 2), (1, 2)], pairs=True))
def m02c(spark, sf):
    """A machine for each pair of classes; the class that wins most of them."""
    return machine_rows(spark, three_classes(spark, sf), 3, ("pairs",))


@query("m02d_machines_conjugate", machine_sql(THREE_SQL, [0, 1, 2]))
def m02d(spark, sf):
    """The same minimum by conjugate gradients, as wide vectors take it."""
    return machine_rows(spark, three_classes(spark, sf), 3, moment_bytes=0, tol=1e-8)


def kernel_sql(label: str, classes: list[int]) -> str:
    """The machines on two random features of the Gaussian kernel of width 0.5."""
    weights, phases = rbf_weights(2, 2, 0.5, 42)
    z = []
    for j in range(2):
        angle = f"({float(weights[0, j])!r})::DOUBLE * x1 + ({float(weights[1, j])!r})::DOUBLE * x2 + ({float(phases[j])!r})::DOUBLE"
        z.append(f"sqrt(2.0::DOUBLE / 2) * cos({angle}) AS z{j}")
    points = "SELECT p_size / 50 AS x1, (p_retailprice - 900) / 1000 AS x2 FROM part"
    rows = f"SELECT row_number() OVER () AS id, z0 AS x1, z1 AS x2, label FROM (SELECT {', '.join(z)}, {label} AS label FROM ({points}))"
    return machine_sql(rows, classes)


def kernel_rows(spark, sf, label, classes: int):
    x1, x2 = F.col("p_size") / 50, (F.col("p_retailprice") - 900) / 1000
    points = table(spark, sf, "part").select(F.array(x1, x2).alias("p"), label(x1, x2).alias("label"))
    mapped = rbf_features(points, "p", 0.5, 2, 42, out="x")
    return machine_rows(spark, mapped.select("x", "label"), classes)


@query("m04d_rbf_machine", kernel_sql("CASE WHEN x1 + x2 > 1 THEN 1 ELSE 0 END", [1]))
def m04d(spark, sf):
    return kernel_rows(spark, sf, lambda a, b: F.when(a + b > 1, 1).otherwise(0), 2)


@query("m05b_rbf_machines_ovr", kernel_sql("CASE WHEN x1 + x2 < 0.7 THEN 0 WHEN x1 - x2 > 0.3 THEN 1 ELSE 2 END", [0, 1, 2]))
def m05b(spark, sf):
    return kernel_rows(spark, sf, lambda a, b: F.when(a + b < 0.7, 0).when(a - b > 0.3, 1).otherwise(2), 3)


# Weights and biases of a small perceptron, input to hidden and hidden to output.
LAYERS = [
    ([[1.5, -2.0, 0.5], [-1.0, 0.75, 2.0]], [0.1, -0.2, 0.3]),
    ([[1.0, -1.0], [0.5, 0.25], [-1.5, 1.25]], [0.05, -0.05]),
]


def forward_sql() -> str:
    (first, bias), (second, out_bias) = LAYERS
    hidden = [f"greatest({bias[j]!r}::DOUBLE + ({first[0][j]!r})::DOUBLE * x1 + ({first[1][j]!r})::DOUBLE * x2, 0.0::DOUBLE) AS h{j}" for j in range(3)]
    outputs = [f"({out_bias[k]!r})::DOUBLE + " + " + ".join(f"({second[j][k]!r})::DOUBLE * h{j}" for j in range(3)) + f" AS o{k}" for k in range(2)]
    return (
        "WITH p AS (SELECT p_partkey, p_size / 50 AS x1, (p_retailprice - 900) / 1000 AS x2 FROM part),\n"
        f"h AS (SELECT p_partkey, {', '.join(hidden)} FROM p),\no AS (SELECT p_partkey, {', '.join(outputs)} FROM h)\n"
        "SELECT p_partkey, round(1 / (1 + exp(o1 - o0)), 9) AS p0, round(1 / (1 + exp(o0 - o1)), 9) AS p1 FROM o"
    )


@query("m08b_mlp_forward", forward_sql())
def m08b(spark, sf):
    found = mlp_forward([F.col("p_size") / 50, (F.col("p_retailprice") - 900) / 1000], LAYERS)
    return table(spark, sf, "part").select("p_partkey", *[F.round(p, 9).alias(f"p{k}") for k, p in enumerate(found)])


NET, STEPS, SEED = [2, 3, 2], 4, 42


def epoch_sql() -> str:
    """One epoch of the perceptron as chained tables: every step is one row of weights and optimiser state."""
    (first, bias), (second, out_bias) = mlp.start(NET, SEED)
    values = {f"w{i}{j}": first[i, j] for i in range(2) for j in range(3)} | {f"b{j}": bias[j] for j in range(3)}
    values |= {f"v{j}{k}": second[j, k] for j in range(3) for k in range(2)} | {f"c{k}": out_bias[k] for k in range(2)}
    state = ", ".join(f"({float(v)!r})::DOUBLE AS {n}, 0.0::DOUBLE AS m_{n}, 0.0::DOUBLE AS s_{n}" for n, v in values.items())
    points = (
        f"SELECT p_size / 50 AS x0, (p_retailprice - 900) / 1000 AS x1, CASE WHEN p_size / 50 + (p_retailprice - 900) / 1000 > 1 THEN 1 ELSE 0 END AS y,"
        f" ('0x' || substr(md5(p_partkey::VARCHAR), 1, {HALF}))::BIGINT % {PRIME} % {STEPS} AS batch FROM part"
    )
    ctes = [f"d AS MATERIALIZED ({points})", f"t0 AS (SELECT {state})"]
    losses = []
    for t, b in enumerate(mlp.batch_order(SEED, 0, STEPS), 1):
        hidden = ", ".join(f"greatest(b{j} + w0{j} * x0 + w1{j} * x1, 0.0::DOUBLE) AS h{j}" for j in range(3))
        outs = ", ".join(f"c{k} + " + " + ".join(f"v{j}{k} * h{j}" for j in range(3)) + f" AS o{k}" for k in range(2))
        deltas = ", ".join(f"1 / (1 + exp(o{1 - k} - o{k})) - CASE WHEN y = {k} THEN 1 ELSE 0 END AS e{k}" for k in range(2))
        backs = ", ".join(f"CASE WHEN h{j} > 0 THEN e0 * v{j}0 + e1 * v{j}1 ELSE 0 END AS g{j}" for j in range(3))
        slopes = {f"w{i}{j}": f"x{i} * g{j}" for i in range(2) for j in range(3)} | {f"b{j}": f"g{j}" for j in range(3)}
        slopes |= {f"v{j}{k}": f"h{j} * e{k}" for j in range(3) for k in range(2)} | {f"c{k}": f"e{k}" for k in range(2)}
        sums = ", ".join(f"sum({e}) AS g_{n}" for n, e in slopes.items())
        ctes += [
            f"h{t} AS (SELECT *, {hidden} FROM d, t{t - 1} WHERE batch = {b})",
            f"o{t} AS (SELECT *, {outs} FROM h{t})",
            f"e{t} AS (SELECT *, {deltas}, ln(1 + exp(CASE WHEN y = 1 THEN o0 - o1 ELSE o1 - o0 END)) AS loss FROM o{t})",
            f"g{t} AS (SELECT *, {backs} FROM e{t})",
            f"a{t} AS (SELECT count(*)::DOUBLE AS n, sum(loss) AS loss, {sums} FROM g{t})",
        ]
        penal = " + ".join(f"{n} * {n}" for n in values if n[0] in "wv")
        slope = {n: f"(g_{n} + {mlp.PENALTY if n[0] in 'wv' else 0.0}::DOUBLE * {n}) / n" for n in values}
        moved = ", ".join(
            f"{n}, {mlp.FADE}::DOUBLE * m_{n} + (1 - {mlp.FADE}::DOUBLE) * ({slope[n]}) AS m_{n},"
            f" {mlp.FADE_SQUARES}::DOUBLE * s_{n} + (1 - {mlp.FADE_SQUARES}::DOUBLE) * ({slope[n]}) * ({slope[n]}) AS s_{n}"
            for n in values
        )
        rate = f"({mlp.RATE}::DOUBLE * sqrt(1 - {mlp.FADE_SQUARES}::DOUBLE ** {t}) / (1 - {mlp.FADE}::DOUBLE ** {t}))"
        after = ", ".join(f"{n} - {rate} * m_{n} / (sqrt(s_{n}) + {mlp.TINY}::DOUBLE) AS {n}, m_{n}, s_{n}" for n in values)
        ctes += [
            f"m{t} AS (SELECT n, loss + 0.5::DOUBLE * {mlp.PENALTY}::DOUBLE * ({penal}) AS loss, {moved} FROM a{t}, t{t - 1})",
            f"t{t} AS MATERIALIZED (SELECT n AS seen, loss AS cost, {after} FROM m{t})",
        ]
        losses.append(f"SELECT seen, cost FROM t{t}")
    ends = [f"SELECT '{n}' AS name, round({n}, 6) + 0.0::DOUBLE AS value FROM t{STEPS}" for n in values]
    ends.append(f"SELECT 'loss', round(sum(cost) / sum(seen), 6) FROM ({' UNION ALL '.join(losses)})")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(ends)


@query("m08c_mlp_epoch", epoch_sql())
def m08c(spark, sf):
    """Weights and loss after one epoch, whose four steps are jobs."""
    x0, x1 = F.col("p_size") / 50, (F.col("p_retailprice") - 900) / 1000
    rows = table(spark, sf, "part").select("p_partkey", F.array(x0, x1).alias("x"), F.when(x0 + x1 > 1, 1).otherwise(0).alias("y"))
    model = mlp.Perceptron(2, (3,), "x", "y", max_iter=1, seed=SEED, key="p_partkey", steps=STEPS, in_task_values=0).fit(rows)
    (first, bias), (second, out_bias) = model.weights()
    found = [(f"w{i}{j}", first[i, j]) for i in range(2) for j in range(3)] + [(f"b{j}", bias[j]) for j in range(3)]
    found += [(f"v{j}{k}", second[j, k]) for j in range(3) for k in range(2)] + [(f"c{k}", out_bias[k]) for k in range(2)]
    out = [(n, round(float(v), 6) + 0.0) for n, v in [*found, ("loss", model.losses[0])]]
    return spark.createDataFrame(out, "name string, value double")
