"""Time single steps on ``lineitem`` repeated ``BENCH_COPIES`` times and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Copies differ in their key only.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from fitgrid.models.kmeans import fit_kmeans_best_of  # noqa: E402
from fitgrid.models.linear import fit_ols  # noqa: E402
from fitgrid.models.svm import LinearMachine  # noqa: E402
from fitgrid.models.trees import Forest  # noqa: E402
from fitgrid.operators.features import fit_scaler  # noqa: E402
from fitgrid.operators.split import ordered_split, random_split  # noqa: E402
from fitgrid.operators.stats import group_stats, latency_summary  # noqa: E402
from fitgrid.session import build_session, materialise  # noqa: E402

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("BENCH_COPIES", "100"))
    spark = build_session("bench-scaled", int(os.environ.get("BENCH_CPUS", "8")))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", *NUMBERS)
    key = F.col("copy") * 10**9 + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    whole = lines.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))))
    point = F.array(*[F.col(c).cast("double") for c in NUMBERS])
    whole = materialise(whole.select(key.alias("id"), "l_returnflag", *NUMBERS, point.alias("features"), (F.col("l_quantity") > 25).cast("int").alias("label")), "lines")
    steps = {
        "least_squares": lambda: fit_ols(whole, NUMBERS[:1] + NUMBERS[2:], "l_extendedprice"),
        "group_statistics": lambda: run(group_stats(whole, ["l_returnflag"], NUMBERS)),
        "scaler": lambda: fit_scaler(whole, NUMBERS),
        "percentiles_of_groups": lambda: run(latency_summary(whole, ["l_returnflag"], "l_extendedprice")),
        "ordered_split": lambda: run(ordered_split(whole.select("id"), ["id"])),
        "random_split": lambda: run(random_split(whole.select("id"), "id")),
        "linear_machine": lambda: LinearMachine(classes=2).fit(whole),
        "tree_depth_3": lambda: Forest(classes=2, max_depth=3).fit(whole),
        "kmeans_8_one_start_5_rounds": lambda: fit_kmeans_best_of(whole, "features", 8, seeds=(0,), max_iter=5, key="id"),
    }
    times = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - start, 2)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rows = whole.count()
    spark.stop()
    print(json.dumps({"rows": rows, "unit": "sec", "steps": times, "rows_per_sec": {n: round(rows / t) for n, t in times.items()}}))


if __name__ == "__main__":
    main()
