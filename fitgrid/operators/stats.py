"""Grouped statistics of runs and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import size_class
from ..plans.joins import lookup_join
from ..session import materialise

STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
}
SAMPLE_FIELDS = ("mean", "std_dev", "min", "max", "count")
GROUP_ROWS = 1_000_000
SLACK = 2e-4
FINER = 64


def dataset_profile(
    df: DataFrame, target: str | None = None, small_below: int = 1000, approximate: bool = False
) -> DataFrame:
    """One row: number of rows, features and target classes, and the size class."""
    target = target or df.columns[-1]
    distinct = F.approx_count_distinct(target, 0.01) if approximate else F.count_distinct(target)
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"), distinct.alias("n_classes")
    ).select(
        "n_samples",
        F.lit(len(df.columns) - 1).alias("n_features"),
        "n_classes",
        size_class(F.col("n_samples"), small_below).alias("size_category"),
    )


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    digits: int | None = 6,
    optional: Sequence[str] = (),
    ddof: int = 1,
    count: str | None = None,
) -> DataFrame:
    """``metric_stat`` columns per group; metrics in ``optional`` only if present."""
    present = [*metrics, *[m for m in optional if m in df.columns and m not in metrics]]
    forms = {**STATS, "std": F.stddev_samp if ddof == 1 else F.stddev_pop}
    aggs = [F.count(F.lit(1)).alias(count)] if count else []
    for m in present:
        for s in stats:
            value = forms[s](F.col(m))
            aggs.append((F.round(value, digits) if digits is not None else value).alias(f"{m}_{s}"))
    return df.groupBy(*keys).agg(*aggs)


def sample_fields(col: str, ddof: int = 1, single: str = "zero") -> list[Column]:
    """Mean, deviation, minimum, maximum and count of one sample column.

    ``single='zero'`` reports 0 for one sample and for none, ``'null'`` leaves null.
    """
    value = F.col(col).cast("double")
    std = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    fields = [F.avg(value), std, F.min(value), F.max(value)]
    if single == "zero":
        fields = [F.coalesce(f, F.lit(0.0)) for f in fields]
    fields.append(F.count(value))
    return [f.alias(n) for f, n in zip(fields, SAMPLE_FIELDS)]


def sample_stats(df: DataFrame, keys: Sequence[str], col: str, ddof: int = 1, single: str = "zero") -> DataFrame:
    """Statistics per group, or one row for the whole frame when there are no keys."""
    fields = sample_fields(col, ddof, single)
    return df.groupBy(*keys).agg(*fields) if keys else df.agg(*fields)


def stats_by_key(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], ddof: int = 0) -> DataFrame:
    """Statistics of each metric per group, nested, with the composed key ``a_b`` beside the keys.

    Groups are told apart by their keys, so two that compose to the same text stay two.
    """
    nested = [F.struct(*sample_fields(m, ddof)).alias(f"{m}_stats") for m in metrics]
    grouped = df.groupBy(*keys).agg(*nested)
    return grouped.select(F.concat_ws("_", *keys).alias("group_key"), *grouped.columns)


def latency_summary(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    qs: Sequence[float] = (0.5, 0.9, 0.99),
    approximate: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Mean and percentiles with linear interpolation, one column ``pNN`` each.

    The built-in ``percentile`` holds a group's values in one task, so it is
    used for groups of at most ``group_rows`` rows only. For larger ones a sketch per
    group proposes borders around the wanted positions, exact counts between the
    borders decide, and only the cells that hold a position are sorted.
    """
    names = [f"p{q * 100:g}".replace(".", "_") for q in qs]
    value = F.col(col).cast("double")
    if approximate:
        base = df.groupBy(*keys) if keys else df.groupBy(F.lit(0).alias("_all"))
        return _built_in(base, value, F.percentile_approx(value, list(qs), 10_000), keys, names)
    source = df.withColumn("_g", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    sizes = source.groupBy("_g").agg(F.count(value).alias("_rows"), F.avg(value).alias("mean"), *[F.first(k).alias(k) for k in keys])
    large = sizes.filter(F.col("_rows") > group_rows)
    if not large.take(1):
        base = df.groupBy(*keys) if keys else df.groupBy(F.lit(0).alias("_all"))
        return _built_in(base, value, F.percentile(value, list(qs)), keys, names)
    large = materialise(large, "large-groups")
    small = lookup_join(source, large.select("_g"), "_g", "left_anti")
    some = _built_in(small.groupBy("_g", *keys), value, F.percentile(value, list(qs)), keys, names)
    values = lookup_join(source.select("_g", value.alias("_v")).filter(F.col("_v").isNotNull()), large.select("_g"), "_g", "left_semi")
    points = _percentiles_by_cells(values, large.select("_g", "_rows"), list(qs), names, group_rows)
    return some.unionByName(large.join(points, "_g").select(*some.columns))


def _built_in(base, value: Column, found: Column, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    out = base.agg(F.avg(value).alias("mean"), found.alias("_found"))
    return out.select(*keys, "mean", *[F.col("_found")[i].alias(n) for i, n in enumerate(names)])


def _percentiles_by_cells(values: DataFrame, sizes: DataFrame, qs: Sequence[float], names: Sequence[str], group_rows: int) -> DataFrame:
    """Percentiles of large groups: ``_g`` and one column per name, from ``_g, _v`` and rows per group.

    A group's borders are some of its values; a cell is a border (odd number) or what lies between two.
    A position in a border's cell is found; cells between borders get further borders until they hold no
    more than ``group_rows`` rows. Every group has its own borders, so none of its tasks is larger than a cell.
    """
    near = sorted({min(1.0, max(0.0, q + side * SLACK)) for q in qs for side in (-1, 1)})
    borders = values.groupBy("_g").agg(F.percentile_approx("_v", near, 10_000).alias("_b"))
    borders = materialise(borders.withColumn("_b", F.array_sort(F.array_distinct("_b"))), "borders")
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    asked = sizes.select("_g", "_rows", F.explode(each).alias("a")).select("_g", "a.i", (F.col("a.q") * (F.col("_rows") - 1)).alias("_at"))
    asked = asked.select("_g", "i", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_pos"))
    while True:
        below = F.size(F.filter("_b", lambda b: b < F.col("_v")))
        cell = (2 * below + F.array_contains("_b", F.col("_v")).cast("int")).alias("_cell")
        placed = lookup_join(values, borders, "_g").select("_g", "_v", cell)
        upto = Window.partitionBy("_g").orderBy("_cell")
        cells = placed.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("_n"))
        cells = cells.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).join(borders, "_g")
        border = F.when(F.col("_cell") % 2 == 1, F.get("_b", ((F.col("_cell") - 1) / 2).cast("int")))
        inside = (F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_n"))
        wanted = asked.join(cells.withColumn("_found", border).drop("_b"), "_g").filter(inside)
        wanted = materialise(wanted, "percentile-positions")
        crowded = wanted.filter(F.col("_found").isNull() & (F.col("_n") > group_rows))
        if not crowded.take(1):
            break
        chosen = crowded.groupBy("_g").agg(F.collect_set("_cell").alias("_cells"))  # as many as positions at most
        rows = lookup_join(placed, chosen, "_g", "inner").filter(F.array_contains("_cells", F.col("_cell")))
        grid = [i / FINER for i in range(FINER + 1)]
        finer = rows.groupBy("_g", "_cell").agg(F.percentile_approx("_v", grid, 10_000).alias("_more"))
        finer = finer.groupBy("_g").agg(F.flatten(F.collect_list("_more")).alias("_more"))
        joined = borders.join(finer, "_g", "left").withColumn("_more", F.coalesce("_more", F.array().cast("array<double>")))
        borders = materialise(joined.select("_g", F.array_sort(F.array_distinct(F.concat("_b", "_more"))).alias("_b")), "borders")
    # equal values are counted before the sort; only cells asked for take part
    chosen = wanted.filter(F.col("_found").isNull()).groupBy("_g").agg(F.collect_set("_cell").alias("_cells"))
    counted = lookup_join(placed, chosen, "_g", "inner").filter(F.array_contains("_cells", F.col("_cell")))
    counted = counted.groupBy("_g", "_cell", "_v").agg(F.count(F.lit(1)).alias("_c"))
    running = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_g", "_cell").orderBy("_v")))
    at = F.col("_pos") - F.col("_before")
    sorted_out = running.join(wanted.filter(F.col("_found").isNull()), ["_g", "_cell"]).filter((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c")))
    kept = ["_g", "i", "_at", "_pos"]
    hits = sorted_out.select(*kept, "_v").unionByName(wanted.filter(F.col("_found").isNotNull()).select(*kept, F.col("_found").alias("_v")))
    ends = hits.groupBy("_g", "i").agg(F.min_by("_v", "_pos").alias("_low"), F.max_by("_v", "_pos").alias("_high"), F.first("_at").alias("_at"))
    point = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return ends.groupBy("_g").agg(*[F.max(F.when(F.col("i") == i, point)).alias(n) for i, n in enumerate(names)])



def throughput(df: DataFrame, keys: Sequence[str], seconds: str, out: str = "samples_per_sec") -> DataFrame:
    """Rows per second of summed duration; null when no time was spent."""
    rate = F.try_divide(F.count(F.lit(1)).cast("double"), F.sum(F.col(seconds).cast("double")))
    return df.groupBy(*keys).agg(rate.alias(out))


def mean_peak(samples: DataFrame, runs: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Mean and peak of the samples of every run; runs without samples report 0."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).cast("double").alias(f"{c}_peak")]
    summed = samples.groupBy(key).agg(*aggs)
    joined = runs.select(key).join(summed, key, "left")
    return joined.select(
        key, *[F.coalesce(F.col(f"{c}_{s}"), F.lit(0.0)).alias(f"{c}_{s}") for c in cols for s in ("mean", "peak")]
    )


def peak_record(
    df: DataFrame, keys: Sequence[str], by: str, keep: Sequence[str], order_by: Sequence[str], out: str = "peak"
) -> DataFrame:
    """The whole record with the highest ``by``, or the first record if none exceeds it.

    The first record in ``order_by`` is the baseline; among equal peaks the
    earliest counts. Both come from the same aggregate.
    """
    record = F.struct(*keep)
    place = F.struct(*order_by)
    best = F.min_by(record, F.struct((-F.col(by)).alias("v"), place.alias("p")))
    base = F.min_by(record, place)
    both = df.groupBy(*keys).agg(best.alias("_best"), base.alias("_base"))
    rises = F.col(f"_best.{by}") > F.col(f"_base.{by}")
    return both.select(*keys, F.when(rises, F.col("_best")).otherwise(F.col("_base")).alias(out))


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def stats_struct(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], ddof: int = 0) -> DataFrame:
    """Report rows: one struct ``mean, std_dev, min_val, max_val, count`` per metric."""
    aggs = []
    for m in metrics:
        mean, std, low, high, count = sample_fields(m, ddof)
        aggs.append(
            F.struct(mean, std, low.alias("min_val"), high.alias("max_val"), count).alias(f"{m}_stats")
        )
    return df.groupBy(*keys).agg(*aggs)


def flatten_stats(df: DataFrame) -> DataFrame:
    """``metric_mean`` and ``metric_std`` columns from every ``metric_stats`` struct."""
    cols: list[Column] = []
    for name in df.columns:
        if name.endswith("_stats"):
            metric = name.removesuffix("_stats")
            cols += [
                F.col(f"{name}.mean").alias(f"{metric}_mean"),
                F.col(f"{name}.std_dev").alias(f"{metric}_std"),
                F.col(f"{name}.min_val").alias(f"{metric}_min"),
                F.col(f"{name}.max_val").alias(f"{metric}_max"),
                F.col(f"{name}.count").alias(f"{metric}_n"),
            ]
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def append_results(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; fields a frame lacks are null."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole
