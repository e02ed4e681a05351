"""Exact quantiles and order numbers of columns of any size: counts of distinct values, range partitions, and sums of their sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.sources.files import materialize


def numbered_values(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """by, column, _n, _before, _total: each distinct value's count, the rows of its group below it, and all rows of its group.

    Nulls and NaN don't count. Values are dealt by range; only one number per group and range meets in a task, so neither a large group nor many
    distinct values gather. The dealt counts are written once, so all that follows sees the same borders.
    """
    by = list(by)
    counts = df.where(known(df, column)).groupBy(*by, column).agg(F.count("*").alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(counts.repartitionByRange(n, *by, column).withColumn("_p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_p", *by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_p", *by).agg(F.sum("_n").alias("_s"))
    sizes = sizes.select("_p", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"), F.sum("_s").over(Window.partitionBy(*by)).alias("_total"))
    own = parts.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return own.join(sizes.withColumnRenamed("_p", "_q"), (F.col("_p") == F.col("_q")) & _same(by)).select(*by, column, "_n", (F.col("_base") + F.col("_own")).alias("_before"), "_total")


def known(df: DataFrame, column: str) -> Column:
    """Whether a value counts: null and NaN are missing ones."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) if df.select(column).schema[0].dataType.typeName() in ("float", "double") else c.isNotNull()


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return out


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """by, out (array of double): the exact quantiles of a column for each group, linearly interpolated; without by one row, nulls for no values."""
    values = numbered_values(df, column, by)
    picks = []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for name, index in (("a", F.floor(at)), ("b", F.ceil(at))):
            picks.append(F.max(F.when((F.col("_before") <= index) & (index < F.col("_before") + F.col("_n")), F.col(column).cast("double"))).alias(f"_{name}{i}"))
    found = values.groupBy(*by).agg(F.max("_total").alias("_t"), *picks)
    each = []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("_t") - 1)
        each.append(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (at - F.floor(at)))
    return found.select(*by, F.array(*each).alias(out))
