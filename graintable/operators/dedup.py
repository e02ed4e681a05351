"""Dedup by two keys in arrival order, exactly as a loop over the rows decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graintable.operators.relational import first_per_key
from graintable.sources.files import Successive, materialize


def dedup_two_keys(df: DataFrame, first: str, second: str, order: Sequence[str], junk: Column | None = None, small: int = 200_000) -> DataFrame:
    """The rows that a loop in arrival order keeps: a row stays if no row kept before it has its first key, or its second one.

    order: columns, ascending, nulls first; rows that are alike in them go by their keys. Rows without a first key (null or empty) go, rows without a second one
    claim and hit the first only. Rows that are junk go beforehand, so they never claim a key. The second key may be a long
    text: rows are compared by its 128-bit digest.

    A row that is rejected claims nothing, so a later row may have its first key with another second one, and whether it stays hangs on what
    was kept before: that is settled in rounds over distinct pairs of keys and their first arrivals (no other column moves). In a round each pair that
    comes first among the undecided ones of both its keys is kept, and the pairs that share a key with it go. Each round settles all
    local firsts at once; when no more than `small` pairs are undecided, one pass over them in order settles the rest.
    """
    if junk is not None:
        df = df.where(~F.coalesce(junk, F.lit(False)))
    text = F.coalesce(F.col(second).cast("string"), F.lit(""))
    has_first = F.col(first).isNotNull() & (F.col(first).cast("string") != "")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.where(has_first).select(whole.alias("_row"), F.col(first).alias("_k1"), F.when(text != "", F.unhex(F.md5(text))).alias("_k2"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"))
    # with the keys behind it, the order tells any two pairs apart
    pairs = rows.groupBy("_k1", "_k2").agg(F.min("_o").alias("_a")).select("_k1", "_k2", F.struct("_a", "_k1", "_k2").alias("_o"))
    table = Successive("dedup-open")
    undecided, kept = table.put(pairs), None
    while undecided.count() > small:
        firsts = undecided.groupBy("_k1").agg(F.min("_o").alias("_m1"))
        seconds = undecided.where("_k2 is not null").groupBy("_k2").agg(F.min("_o").alias("_m2"))
        leads = undecided.join(firsts, "_k1").join(seconds, "_k2", "left").where((F.col("_o") == F.col("_m1")) & (F.col("_k2").isNull() | (F.col("_o") == F.col("_m2"))))
        leads = materialize(leads.select("_k1", "_k2", "_o"), "dedup-kept")
        kept = leads if kept is None else kept.unionByName(leads)
        undecided = table.put(undecided.join(leads.select("_k1"), "_k1", "left_anti").join(leads.where("_k2 is not null").select("_k2"), "_k2", "left_anti").select("_k1", "_k2", "_o"))
    rest = in_order(undecided)
    kept = (rest if kept is None else kept.unionByName(rest)).select(F.col("_k1").alias("_w1"), F.col("_k2").alias("_w2"), F.col("_o._a").alias("_wo"))
    found = rows.join(kept, (F.col("_k1") == F.col("_w1")) & F.col("_k2").eqNullSafe(F.col("_w2")) & F.col("_o").eqNullSafe(F.col("_wo")), "left_semi")
    return first_per_key(found, ["_k1", "_k2"], [F.xxhash64("_row")]).select("_row.*")


def in_order(pairs: DataFrame) -> DataFrame:
    """The pairs (_k1, _k2) that a loop in the order _o keeps: one task, for a number of pairs that is known to be small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = set(), set()
        for b in batches:
            stays = []
            for k1, k2 in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = k1 not in first and (k2 is None or k2 not in second)
                if new:
                    first.add(k1)
                    if k2 is not None:
                        second.add(k2)
                stays.append(new)
            yield b.filter(pa.array(stays, pa.bool_()))

    ordered = pairs.coalesce(1).sortWithinPartitions("_o")
    return ordered.mapInArrow(run, ordered.schema)
