"""Statistics over tables: coverage, counts, distributions, metrics, variance shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.operators.quantiles import numbered_values, quantiles
from graintable.sources.files import materialize


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, filled, percent (2 digits), missing: one pass over df."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["_n"], list(columns), "column", "filled").select(
        "column", "filled", F.round(F.try_divide(F.col("filled") * 100.0, F.col("_n")), 2).alias("percent"), (F.col("_n") - F.col("filled")).alias("missing"))


def coverage_by_parent(df: DataFrame, ranges: Mapping[str, tuple[float, float]], parent: str) -> DataFrame:
    """column, valid, parents: rows in range and distinct parents with such a row."""
    return df.agg(*[F.array(F.count_if(F.col(c).between(*r)), F.count_distinct(F.when(F.col(c).between(*r), F.col(parent)))).alias(c) for c, r in ranges.items()]) \
        .unpivot([], list(ranges), "column", "x").select("column", F.col("x")[0].alias("valid"), F.col("x")[1].alias("parents"))


def value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values with count and share of all rows (4 digits); ties by value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("_t"), 4).alias("share")).orderBy(F.desc("n"), column).limit(n)


def tag_counts(df: DataFrame, tags: Column) -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a with b's other columns for equal keys, null keys among them; without keys both are single rows."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row each
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(b, on).drop(*[f"_k_{k}" for k in keys])


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, x: a row for each value of the columns, as double; NaN is missing, as null is."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("x")) for c in columns])).alias("_")).select("_.*")


def describe_numeric(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """column, n, mean, median, q1, q3, least, greatest, deviation; NaN is missing, as null is. Quantiles are exact at any size (see quantiles())."""
    rows = long_form(df, columns)
    stats = rows.groupBy("column").agg(F.count("x").alias("n"), F.round(F.avg("x"), digits).alias("mean"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.round(F.stddev_samp("x"), digits).alias("deviation"))
    q = quantiles(rows, "x", [0.25, 0.5, 0.75], ["column"])
    return stats.join(q, "column", "left").select("column", "n", "mean", *[F.round(F.col("q")[i], digits).alias(name) for i, name in ((1, "median"), (0, "q1"), (2, "q3"))], "least", "greatest", "deviation")


def percentile_by_index(df: DataFrame, column: str, percents: Sequence[int]) -> DataFrame:
    """percent, value: the value at index floor(n * percent / 100) in ascending order, from counts of distinct values."""
    picks = [F.struct(F.lit(p).alias("percent"), F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_n")), F.col(column))).alias("value")) for p in percents for i in [F.floor(F.col("_total") * p / 100)]]
    return numbered_values(df, column).agg(F.array(*picks).alias("x")).select(F.inline("x")).where("value is not null")


def survival_counts(df: DataFrame, column: str, cuts: Sequence[float]) -> DataFrame:
    """cut, n: rows of at least each cut."""
    return df.agg(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.count_if(F.col(column) >= c).alias("n")) for c in cuts]).alias("x")).select(F.inline("x"))


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """low, n of each bucket [low, high); the last one is closed."""
    pairs = list(zip(edges, edges[1:], strict=False))
    hits = [(F.col(column) >= a) & ((F.col(column) <= b) if i == len(pairs) - 1 else (F.col(column) < b)) for i, (a, b) in enumerate(pairs)]
    return df.agg(F.array(*[F.struct(F.lit(float(a)).alias("low"), F.count_if(h).alias("n")) for (a, _), h in zip(pairs, hits, strict=True)]).alias("x")).select(F.inline("x"))


def counts_with_gaps(df: DataFrame, period: Column) -> DataFrame:
    """period (int), n for every period from the first to the last, 0 where there is no row; peak marks the largest (the first of them)."""
    counts = df.where(period.isNotNull()).groupBy(period.cast("int").alias("period")).agg(F.count("*").alias("n"))
    spine = counts.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("period"))
    top = counts.agg(F.min_by("period", F.struct(-F.col("n"), "period")).alias("_top"))
    return spine.join(counts, "period", "left").crossJoin(F.broadcast(top)).select("period", F.coalesce("n", F.lit(0)).alias("n"), (F.col("period") == F.col("_top")).alias("peak"))


def length_buckets(df: DataFrame, column: str, cuts: Sequence[int]) -> DataFrame:
    """bucket, n: 'none' for null or empty, else the range of the text's length."""
    n = F.coalesce(F.length(column), F.lit(0))
    kind = F.when(n == 0, "none")
    low = 1
    for c in cuts:
        kind = kind.when(n < c, f"{low}-{c - 1}")
        low = c
    return df.groupBy(kind.otherwise(f"{low}+").alias("bucket")).agg(F.count("*").alias("n"))


def fill_rates(df: DataFrame, map_col: str, by: Sequence[str] = (), either: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """by, key, n, rate of a map column's keys over all rows, or those of each group; either adds keys that count where any of theirs is filled."""
    keys = F.map_keys(map_col)
    for name, parts in (either or {}).items():
        keys = F.when(F.arrays_overlap(F.map_keys(map_col), F.array(*map(F.lit, parts))), F.array_append(keys, name)).otherwise(keys)
    total = df.groupBy(*by).agg(F.count("*").alias("_t"))
    counts = df.select(*by, F.explode(keys).alias("key")).groupBy(*by, "key").agg(F.count("*").alias("n"))
    return same_keys(counts, total, by).select(*by, "key", "n", F.round(F.col("n") / F.col("_t"), 4).alias("rate"))


def group_medians(df: DataFrame, group: str, y: str, least: int) -> DataFrame:
    """group, n, median of groups with at least `least` values."""
    counts = df.groupBy(group).agg(F.count(y).alias("n")).where(F.col("n") >= least)
    return same_keys(counts, quantiles(df, y, [0.5], [group]), [group]).select(group, "n", F.round(F.col("q")[0], 6).alias("median"))


def box_stats(df: DataFrame, group: str, y: str) -> DataFrame:
    """group, q1, median, q3, mean, low and high whisker (1.5 times the quartile range), outliers."""
    means = df.groupBy(group).agg(F.avg(y).alias("_m"))
    boxes = same_keys(means, quantiles(df, y, [0.25, 0.5, 0.75], [group], "_q"), [group]).withColumn("_i", (F.col("_q")[2] - F.col("_q")[0]) * 1.5)
    boxes = materialize(boxes, "boxes")  # its size is known then, so few groups are broadcast and no group's rows gather in a task
    inside = F.col(y).between(F.col("_q")[0] - F.col("_i"), F.col("_q")[2] + F.col("_i"))
    return (same_keys(df, boxes, [group]).groupBy(group, "_q", "_m").agg(F.min(F.when(inside, F.col(y))).alias("low"), F.max(F.when(inside, F.col(y))).alias("high"), F.count_if(~inside).alias("outliers"))
            .select(group, *[F.round(F.col("_q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.round("_m", 4).alias("mean"), "low", "high", "outliers"))


def log_pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    ok = df.where(F.col(x).isNotNull() & (F.col(y) > 0))
    return ok.agg(F.count("*").alias("n"), F.round(F.corr(F.col(x).cast("double"), F.log(y)), 6).alias("r"))


def log_trend(df: DataFrame, x: str, y: str, points: int) -> DataFrame:
    """x, y: points of the line of log y on x, evenly over the range of x."""
    fit = df.where(F.col(x).isNotNull() & (F.col(y) > 0)).agg(F.regr_slope(F.log(y), F.col(x)).alias("b"), F.regr_intercept(F.log(y), F.col(x)).alias("a"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)) \
        .select(F.round("x", 6).alias("x"), F.round(F.exp(F.col("a") + F.col("b") * F.col("x")), 3).alias("y"))


def corr_matrix(df: DataFrame, columns: Sequence[str], least: int = 3) -> DataFrame:
    """a, b, r: pairwise correlations over rows with at least `least` of the columns, in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    return df.na.drop(thresh=least, subset=list(columns)).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("r")) for a, b in pairs]).alias("x")).select(F.inline("x"))


def noise_ceiling(df: DataFrame, y: str, levels: Sequence[Sequence[str]], least: int | Sequence[int] = 3) -> DataFrame:
    """level, groups, ceiling: max(0, 1 - pooled within-group variance of log y over its total), over groups of at least `least` rows (one number, or one a level)."""
    base = df.where(F.col(y) > 0).withColumn("_l", F.log(y))
    total = base.agg(F.var_samp("_l").alias("_t"))
    out = None
    for keys, few in zip(levels, [least] * len(levels) if isinstance(least, int) else least, strict=True):
        groups = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.coalesce(F.var_samp("_l"), F.lit(0.0)).alias("_v")).where(F.col("_n") >= few)
        one = groups.agg(F.count("*").alias("groups"), F.try_divide(F.sum(F.col("_v") * (F.col("_n") - 1)), F.sum(F.col("_n") - 1)).alias("_w")).crossJoin(total) \
            .select(F.lit("+".join(keys)).alias("level"), "groups", F.round(F.greatest(F.lit(0.0), 1 - F.col("_w") / F.col("_t")), 6).alias("ceiling"))
        out = one if out is None else out.unionByName(one)
    return out


def _metrics(y: str, p: str) -> list[Column]:
    e = F.col(p) - F.col(y)
    total = F.var_pop(y) * F.count(y)
    log_total = F.var_pop(F.log(y)) * F.count(y)
    log_e = F.log(p) - F.log(y)
    return [F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
            F.round(1 - F.try_divide(F.sum(e * e), total), 6).alias("r2"), F.round(1 - F.try_divide(F.sum(log_e * log_e), log_total), 6).alias("log_r2")]


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), median: bool = True) -> DataFrame:
    """n, mae, rmse, mdae (median of absolute errors, if asked for), r2, log_r2 of predictions p > 0 for y > 0; optionally of each group."""
    ok = df.where((F.col(y) > 0) & (F.col(p) > 0))
    found = ok.groupBy(*by).agg(*_metrics(y, p))
    if not median:
        return found
    errors = quantiles(ok.select(*by, F.abs(F.col(p) - F.col(y)).alias("_e")), "_e", [0.5], by)
    return same_keys(found, errors, by).select(*by, "n", "mae", "rmse", F.round(F.col("q")[0], 6).alias("mdae"), "r2", "log_r2")


def binned_metrics(df: DataFrame, y: str, p: str, edges: Sequence[float], least: int = 5, last: float | None = None) -> DataFrame:
    """low, n, mae, mape, rmse, log_r2 of each bin [low, next) of y with at least `least` rows; `last` ends the last bin."""
    low = F.lit(None).cast("double")
    for e in edges:
        low = F.when(F.col(y) >= e, float(e)).otherwise(low)
    if last is not None:
        low = F.when(F.col(y) < last, low)
    e = F.abs(F.col(p) - F.col(y))
    named = dict(zip(("n", "mae", "rmse", "r2", "log_r2"), _metrics(y, p), strict=True))
    return (df.withColumn("low", low).where("low is not null").groupBy("low")
            .agg(named["n"], named["mae"], F.round(F.avg(e / F.col(y)) * 100, 6).alias("mape"), named["rmse"], named["log_r2"]).where(F.col("n") >= least))


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy, macro_f1 (a class without hits counts 0)."""
    cells = df.groupBy(y, p).agg(F.count("*").alias("n"))
    both = cells.select(F.col(y).alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0).alias("h")) \
        .unionByName(cells.select(F.col(p).alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h")))
    per = both.groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    return per.agg(F.round(F.sum("h") / F.sum("t"), 6).alias("accuracy"), F.round(F.avg(F.coalesce(F.try_divide(2.0 * F.col("h"), F.col("t") + F.col("g")), F.lit(0.0))), 6).alias("macro_f1"))


def fold_rare(df: DataFrame, column: str, least: int, other: str = "other") -> DataFrame:
    """Values with under `least` rows become `other`; rows of `other` go if that has under `least` rows still."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    renamed = counts.withColumn("_new", F.when(F.col("_n") < least, other).otherwise(F.col(column)))
    sizes = renamed.groupBy("_new").agg(F.sum("_n").alias("_m"))
    keep = renamed.join(sizes, "_new").where((F.col("_new") != other) | (F.col("_m") >= least)).select(column, "_new")
    return df.join(keep, column).withColumn(column, F.col("_new")).select(*df.columns)


def interval_coverage(df: DataFrame, y: str, low: str, high: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double")), 6).alias("covered"))


def source_bias(df: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """Medians of both sources, median and mean difference, and a verdict at the threshold."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), (F.col(a) - F.col(b)).cast("double").alias("d"))
    q = quantiles(long_form(both, ["a", "b", "d"]), "x", [0.5], ["column"]).agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"_{c}") for c in "abd"])
    return both.agg(F.count("*").alias("n"), F.avg("d").alias("_e")).crossJoin(F.broadcast(q)).select(  # one row each
        "n", F.round("_a", 4).alias("median_a"), F.round("_b", 4).alias("median_b"), F.round("_d", 4).alias("median_diff"), F.round("_e", 4).alias("mean_diff"),
        F.when(F.abs("_d") > threshold, "biased").otherwise("close").alias("verdict"))


def paired_diff(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """n, median_diff of rows where both measures are known."""
    both = df.select((a - b).alias("_x")).where("_x is not null")
    return both.agg(F.count("*").alias("n")).crossJoin(F.broadcast(quantiles(both, "_x", [0.5]))).select("n", F.round(F.col("q")[0], 6).alias("median_diff"))  # one row each


def latest_metric(df: DataFrame, name: str, value: Column, order: Sequence[str]) -> DataFrame:
    """name, latest: the last known value of each metric by order."""
    return df.where(value.isNotNull()).groupBy(name).agg(F.max_by(value, F.struct(*order)).alias("latest"))


def share_report(df: DataFrame, checks: Mapping[str, Column], year: Column | None = None, years: int = 5) -> DataFrame:
    """One row: n, the percentage of rows that meet each check (2 digits), and with year a map of the last years' counts."""
    row = df.agg(F.count("*").alias("n"), *[F.round(F.try_divide(F.count_if(c) * 100.0, F.count("*")), 2).alias(k) for k, c in checks.items()])
    if year is None:
        return row
    last = df.where(year.isNotNull()).groupBy(year.alias("_y")).agg(F.count("*").alias("_n")).orderBy(F.desc("_y")).limit(years)
    return row.crossJoin(F.broadcast(last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_y", "_n")))).alias("last_years"))))  # one row each


def run_summary(df: DataFrame, run: Column, ok: Column, n: int) -> DataFrame:
    """run, ok, total of the n last runs."""
    return df.groupBy(run.alias("run")).agg(F.count_if(ok).alias("ok"), F.count("*").alias("total")).orderBy(F.desc("run")).limit(n)


def metric_history(df: DataFrame, session: str, model: str, value: str) -> DataFrame:
    """df with change: the value less that of the model's session before."""
    return df.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(model).orderBy(session)))


def nested_history(df: DataFrame, session: str, entries: str) -> DataFrame:
    """session, model, value, change of entries, a map of model to metric in each session's row."""
    return metric_history(df.select(session, F.explode(entries).alias("model", "value")), session, "model", "value")


def evidence_share(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """key, share: summed weight over the sum of all."""
    sums = df.groupBy(key).agg(F.sum(weight).alias("_w"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("_w").alias("_t")))).select(key, F.round(F.try_divide(F.col("_w"), F.col("_t")), 8).alias("share"))


def column_density(covered: DataFrame) -> DataFrame:
    """dense (50 % or more), sparse (under 10 %): counts over the output of coverage."""
    return covered.agg(F.count_if(F.col("percent") >= 50).alias("dense"), F.count_if(F.col("percent") < 10).alias("sparse"))


def diff_counts(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    both = before.select(key, F.col(column).alias("_a")).join(after.select(key, F.col(column).alias("_b")), key)
    return both.agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("nulled"))
