"""Joins of intervals of uneven lengths, by bins of their own size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(start: Column, stop: Column) -> Column:
    """The least power of two that an interval's length doesn't exceed, as its exponent (1 at least)."""
    return F.length(F.bin(F.greatest(stop - start, F.lit(0).cast("long")))).cast("int")


def _bins(start: Column, stop: Column, at: Column) -> Column:
    """The one or two bins of width 2 ** at that an interval no longer than that touches."""
    a, b = F.call_function("shiftright", start, at), F.call_function("shiftright", stop, at)
    return F.when(a == b, F.array(F.struct(at.alias("_l"), a.alias("_bin")))).otherwise(F.array(F.struct(at.alias("_l"), a.alias("_bin")), F.struct(at.alias("_l"), b.alias("_bin"))))


def overlaps(a: DataFrame, b: DataFrame, on: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """on, a, b (structs of all their columns): the pairs of rows with equal keys whose intervals (first and last whole number) share a point.

    An interval lies in one or two bins of its own size. Two intervals meet in a bin of the larger one's size, so the shorter one is also
    entered in the bins of every larger size that the other side has (64 sizes at most): one long interval makes no bin of the short ones wider, and
    nothing is compared but what shares a bin. Each pair comes from the bin in which the overlap starts, so it comes once. Rows with a null
    key or end have no pairs.
    """
    def side(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        s, e = (F.col(c).cast("long") for c in span)
        return df.select(*on, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), s.alias(f"_s{name}"), e.alias(f"_e{name}"), level(s, e).alias(f"_l{name}")).where(f"_s{name} <= _e{name}")

    left, right = side(a, a_span, "a"), side(b, b_span, "b")
    sizes = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())  # noqa: E731  64 at most

    def entered(df: DataFrame, name: str, levels: Sequence[int] | None, strictly: bool) -> DataFrame:
        """In its own bins, or in those of the given sizes from its own (strictly: above its own) on."""
        s, e, own = F.col(f"_s{name}"), F.col(f"_e{name}"), F.col(f"_l{name}")
        if levels is None:
            return df.withColumn("_x", F.explode(_bins(s, e, own))).select("*", "_x.*").drop("_x")
        wide = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > own if strictly else x >= own)
        return df.withColumn("_x", F.explode(F.flatten(F.transform(wide, lambda x: _bins(s, e, x))))).select("*", "_x.*").drop("_x")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, [*on, "_l", "_bin"]).where("_sa <= _eb and _sb <= _ea and _bin = shiftright(greatest(_sa, _sb), _l)").select(*on, "a", "b")

    left_levels, right_levels = sizes(left, "_la"), sizes(right, "_lb")
    found = meet(entered(left, "a", None, False), entered(right, "b", left_levels or [0], False))
    if left_levels and right_levels and right_levels[-1] > left_levels[0]:
        found = found.unionByName(meet(entered(left, "a", right_levels, True), entered(right, "b", None, False)))
    return found
