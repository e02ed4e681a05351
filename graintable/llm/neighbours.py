"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.llm.common import bounded_sample, materialize, table


@dataclass
class Tree:
    """Inner nodes: normal and cut, children in left and right; a child < 0 is leaf -child - 1."""

    normal: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x, level by level."""
        at = np.zeros(len(x), dtype=np.int64) if len(self.cut) else np.full(len(x), -1, dtype=np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.normal[node]) > self.cut[node]
            at[inner] = np.where(side, self.right[node], self.left[node])
        return -at - 1


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split at the median along the line through two random members until a node has `leaf` members or can't be split."""
    normals, cuts, left, right = [], [], [], []
    leaves = 0
    stack = [(np.arange(len(x)), -1, 0)]
    while stack:
        members, parent, side = stack.pop()
        split = None
        if len(members) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(members, 2, replace=False)]
                n = b - a
                size = np.linalg.norm(n)
                if size < 1e-12:
                    continue
                n = n / size
                p = x[members] @ n
                cut = float(np.median(p))
                over = p > cut
                if 0 < over.sum() < len(members):
                    split = n, cut, over
                    break
        if split is None:
            me, leaves = -leaves - 1, leaves + 1
        else:
            me = len(cuts)
            normals.append(split[0])
            cuts.append(split[1])
            left.append(0)
            right.append(0)
            stack += [(members[~split[2]], me, 0), (members[split[2]], me, 1)]
        if parent >= 0:
            (right if side else left)[parent] = me
    d = x.shape[1] if x.ndim == 2 else 0
    return Tree(np.array(normals).reshape(-1, d), np.array(cuts), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), leaves)


def search(forest: list[Tree], q: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The `visits` leaves (tree, leaf) of all trees with the best margins, from one queue over the whole forest."""
    queue = [(-np.inf, t, 0 if len(tree.cut) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    out: list[tuple[int, int]] = []
    while queue and len(out) < visits:
        worst, t, node = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            m = float(q @ tree.normal[node] - tree.cut[node])
            near, far = (tree.right[node], tree.left[node]) if m > 0 else (tree.left[node], tree.right[node])
            heapq.heappush(queue, (max(worst, abs(m)), t, int(far)))
            node = int(near)
        out.append((t, -node - 1))
    return out


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null, not zero and has finite components only, in double precision."""
    v = F.col(vec_col)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def one_vector(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id, _v (array of double): the usable vectors, one an id; of several vectors under one id the least one counts."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where("_id is not null")
    return usable(rows, "_v").groupBy("_id").agg(F.min("_v").alias("_v"))


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 16,
            sample_rows: int = 20_000, leaf: int = 24, visits: int = 480, part_rows: int = 5_000, seed: int = 7, max_lengths: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of base found for each row of queries but itself.

    Score is the Euclidean distance in double precision, ties to the smaller id. The trees are fit on at most
    sample_rows distinct vectors, by hash; every row is indexed. Equal vectors are one entry of the index, kept with
    its k + 1 smallest ids, which are all that can be among k nearest. Each visited leaf ranks its vectors for its
    queries by matrix products, checked by exact distances, in parts of about part_rows rows. Null, zero, non-finite vectors and null ids
    take no part. An id is one row: repeated rows count once, and of several vectors under one id the least (in array order).
    Vectors are compared with those of their own length only, each length by a forest of its own; more than max_lengths
    lengths are an error. Other columns are not read; an empty table gives no rows.
    """
    fine, asked = materialize(one_vector(base, id_col, vec_col), "ann-rows"), materialize(one_vector(queries, id_col, vec_col), "ann-asked")
    lengths = [r[0] for r in asked.select(F.size("_v").alias("d")).distinct().orderBy("d").limit(max_lengths + 1).collect()]
    if len(lengths) > max_lengths:
        raise ValueError(f"vectors of more than {max_lengths} lengths")
    out = None
    for d in lengths:
        found = nearest_of_length(fine.where(F.size("_v") == d), asked.where(F.size("_v") == d), k, trees, sample_rows, leaf, visits, part_rows, seed)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def nearest_of_length(fine: DataFrame, asked: DataFrame, k: int, trees: int, sample_rows: int, leaf: int, visits: int, part_rows: int, seed: int) -> DataFrame:
    """nearest() for rows (_id, _v) of one length."""
    spark = fine.sparkSession
    first = Window.partitionBy("_v").orderBy("_id")
    classes = (fine.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
               .groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids")).withColumn("_c", F.element_at("_ids", 1)))
    classes = materialize(classes, "ann-classes")
    sample = np.array([r[0] for r in bounded_sample(classes, "_c", sample_rows).select("_v").collect()], dtype=np.float64)
    rng = np.random.default_rng(seed)
    forest = [grow(sample, leaf, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast([(t.normal.astype(np.float32), t.cut.astype(np.float32), t.left, t.right, t.leaves) for t in forest])

    wanted = materialize(asked.groupBy("_v").agg(F.min("_id").alias("_q")), "ann-queries")
    leaves = sum(t.leaves for t in forest)
    # parts of a leaf, so that no task gathers more than about part_rows vectors or queries of it
    salts = max(1, math.ceil(classes.count() * trees / leaves / part_rows))
    slices = max(1, math.ceil(wanted.count() * min(visits, leaves) / leaves / part_rows))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = [Tree(*t) for t in shared.value]
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some = b.slice(at, 2000)
                x = some.column(1).flatten().to_numpy().reshape(some.num_rows, -1).astype(np.float32)
                for i, tree in enumerate(f):
                    yield pa.RecordBatch.from_arrays([pa.array(tree.assign(x) + (np.int64(i) << np.int64(32))), some.column(0), some.column(1)], ["leaf", "_c", "_w"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = [Tree(*t) for t in shared.value]
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float32)
            for i, q in enumerate(x):
                found = search(f, q, visits)
                at = pa.array([i] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array([(t << 32) + leaf_ for t, leaf_ in found], pa.int64()), b.column(0).take(at), b.column(1).take(at)], ["leaf", "_q", "_v"])

    def rerank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The k + 1 nearest of a leaf's part for each of its queries, by exact distances."""
        out_q, out_c, out_s = [], [], []
        if left.num_rows and right.num_rows:
            q, c = left.column("_q").to_numpy(), right.column("_c").to_numpy()
            x = left.column("_v").combine_chunks().flatten().to_numpy().reshape(len(q), -1)
            w = right.column("_w").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
            size = (w * w).sum(axis=1)
            for at in range(0, len(q), 256):
                some = x[at:at + 256]
                rough = np.maximum(size[None, :] + (some * some).sum(axis=1)[:, None] - 2 * some @ w.T, 0)
                n = min(k + 1, len(c))
                cut = np.partition(rough, n - 1, axis=1)[:, n - 1]
                slack = 1e-9 * (size.max() + (some * some).sum(axis=1))  # rounding of the product form
                for i in range(len(some)):
                    near = np.flatnonzero(rough[i] <= cut[i] + slack[i])
                    d = np.sqrt(((some[i] - w[near]) ** 2).sum(axis=1))
                    best = np.lexsort((c[near], d))[:n]
                    out_q.append(np.full(len(best), q[at + i]))
                    out_c.append(c[near][best])
                    out_s.append(d[best])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        return pa.table({"_q": join(out_q, np.int64), "_c": join(out_c, np.int64), "score": join(out_s, np.float64)})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = (classes.select(F.col("_c").cast("long").alias("_c"), "_v").mapInArrow(index, "leaf long, _c long, _w array<double>")
               .withColumn("s", F.pmod(F.xxhash64("_c"), F.lit(salts))).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
    probes = (wanted.select(F.col("_q").cast("long").alias("_q"), "_v").repartition(n, "_q").mapInArrow(probe, "leaf long, _q long, _v array<double>")
              .withColumn("z", F.pmod(F.xxhash64("_q"), F.lit(slices)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
    near = probes.groupBy("leaf", "s", "z").cogroup(entries.withColumn("s", F.col("s").cast("long")).groupBy("leaf", "s", "z")).applyInArrow(rerank, "_q long, _c long, score double")
    by_class = Window.partitionBy("_q").orderBy("score", "_c")
    best = near.groupBy("_q", "_c").agg(F.min("score").alias("score")).withColumn("_r", F.row_number().over(by_class)).where(F.col("_r") <= k + 1)
    top = best.join(classes.select("_c", "_ids"), "_c").select("_q", "score", F.explode("_ids").alias("vec_id"))
    by_row = Window.partitionBy("_q").orderBy("score", "vec_id")
    top = top.withColumn("_r", F.row_number().over(by_row)).where(F.col("_r") <= k + 1).select("_q", "score", "vec_id")
    lists = top.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # k + 1 at most
    answers = asked.select(F.col("_id").alias("query_id"), "_v").join(wanted, "_v").select("query_id", "_q").join(lists, "_q")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    return (answers.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("p", "x"))
            .select(F.col("query_id").cast("long"), (F.col("p") + 1).alias("rank"), F.col("x.vec_id").cast("long").alias("vec_id"), F.col("x.score").alias("score")))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of embeddings for each whose vec_id is divisible by 100; odd rows: see nearest."""
    base = table(spark, sf_dir, "embeddings")
    return nearest(base, base.where("vec_id % 100 = 0"))
