"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graintable.llm.common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). large: every vertex sends its larger neighbours to its least one; else the smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each u of edges (u > v) has one v, which is no other edge's u: a round would give the same edges again."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(x).alias("x"), F.lit(int(x == "u")).alias("is_u")) for x in ("u", "v")])))
    vertices = ends.groupBy("x").agg(F.sum("is_u").alias("as_u"), F.min("is_u").alias("never_v"))
    return not vertices.agg(F.count_if(F.expr("as_u > 1 or as_u = 1 and never_v = 0"))).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex of edges (u long, v long); root is the least vertex it reaches.

    Self-links and repeated links are allowed; an empty table gives an empty table. Only one row a
    round reaches the driver. Raises if it hasn't settled after max_rounds (it needs O(log^2) of them).
    """
    linked = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialize(linked.distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(current):
            roots = current.select(F.col("v").alias("vertex")).distinct().withColumn("root", F.col("vertex"))
            return current.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
        current = materialize(_stars(_stars(current, True), False), "cc")
    raise RuntimeError("components did not settle")
