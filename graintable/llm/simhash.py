"""SimHash near-dedup: fingerprints, generalised pigeonhole search, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.llm.common import bounded_sample, giving_back, materialize, table
from graintable.llm.components import connected_components

BITS = 64
#: Fingerprints of a bucket that are compared pair by pair; larger buckets are split by further bits first.
LARGE = 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; bit set when over half of the shingle hashes have it. No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower: A-Z; bytes.split: \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), len(words) - width + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 8192):
        counts += np.unpackbits(h[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id_col and fp (the 64 bits as a signed long), one row per row of docs; texts are read whole."""
    schema = docs.select(F.col(id_col), F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(giving_back(run), schema)


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deal the 64 bits into m parts, each bit to the part whose bits it correlates with most and that has room."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits ** 2).sum(axis=0)) + 1e-9
    corr = np.abs(bits.T @ bits) / scale[:, None] / scale[None, :]
    np.fill_diagonal(corr, 0)
    room = [BITS // m + (i < BITS % m) for i in range(m)]
    order = list(np.argsort(-corr.max(axis=1), kind="stable"))
    parts: list[list[int]] = [[] for _ in range(m)]
    for b in order:
        open_parts = [i for i in range(m) if len(parts[i]) < room[i]]
        best = max(open_parts, key=lambda i: (corr[b, parts[i]].mean() if parts[i] else 0.02, -len(parts[i]), -i))
        parts[best].append(int(b))
    return [sorted(p) for p in parts]


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.int64)
    for j, b in enumerate(bits):
        out |= (((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)).astype(np.int64)
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most radius bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)]


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum total and least summed cost[i][t_i + 1], by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                x = (c + row[t + 1], [*chosen, t])
                if used + t not in step or x[0] < step[used + t][0]:
                    step[used + t] = x
        best = step
    return best[total]


def plan_search(sample: np.ndarray, n: int, distance: int, choices: tuple[int, ...] = (2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """Bit parts and their thresholds with the least estimated work for n fingerprints.

    A pair at Hamming distance d <= distance has a part that differs in at most t_i bits whenever the
    thresholds sum to distance - m + 1. Work: rows probed, plus candidate pairs estimated from how the
    sample's projections collide.
    """
    found = None
    for m in choices:
        if distance - m + 1 < -m:
            continue
        parts = group_bits(sample, m)
        cost = []
        for p in parts:
            _, counts = np.unique(project(sample, p), return_counts=True)
            s = max(len(sample), 2)
            clash = max(float((counts * (counts - 1)).sum()) / (s * (s - 1)), 0.0) + 2.0 ** -len(p)
            row = [0.0]
            for t in range(max(distance - m + 1, 0) + m):
                if t > distance or t > 3:
                    break
                probes = len(ball(len(p), t))
                row.append(n * probes * 1.0 + 0.5 * n * n * clash * probes)
            cost.append(row)
        try:
            c, t = allocate(cost, distance - m + 1)
        except KeyError:
            continue
        if found is None or c < found[0]:
            found = (c, parts, t)
    return found[1], found[2]


def close_pairs(distinct: DataFrame, distance: int = 3, sample_rows: int = 20_000) -> DataFrame:
    """Links (u, v) between different fingerprints of distinct(fp) that span, with their chains, all pairs within distance.

    In a bucket every pair is compared, but a pair is returned only where it joins two fingerprints that
    the bucket's earlier links leave apart, so a bucket of k gives at most k - 1 rows.
    The bit parts and thresholds are set from sample_rows fingerprints; they change the work, not the result.
    """
    stats = distinct.agg(F.count("*")).first()[0]
    sample = np.array([r[0] for r in bounded_sample(distinct, "fp", sample_rows).collect()], dtype=np.int64).view(np.uint64)
    if len(sample) < 2:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    parts, thresholds = plan_search(sample, stats, distance)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(whole), 4096):
                signed = whole[at:at + 4096]
                fp = signed.view(np.uint64)
                keys, fps, probe = [], [], []
                for i, (p, t) in enumerate(zip(parts, thresholds, strict=True)):
                    if t < 0:
                        continue
                    proj = project(fp, p)
                    for mask in ball(len(p), t):
                        keys.append((proj ^ mask) | (np.int64(i) << np.int64(40)))
                        fps.append(signed)
                        probe.append(np.full(len(fp), mask != 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, fps, probe)], ["key", "fp", "probe"])

    def settle(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of complete, key-sorted groups. A large group is split by further bits: fingerprints within the
        distance agree on one of distance + 1 blocks of all bits, so each block's equal members are groups of their own."""
        key, fp, probe = (np.concatenate(x) for x in zip(*rows, strict=True))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        if (size > LARGE).any():
            large = np.repeat(size > LARGE, size)
            found = [compare(key[~large], fp[~large], probe[~large])]
            group = np.repeat(np.arange(len(size)), size)[large]
            f, p = fp[large], probe[large]
            edges = np.linspace(0, BITS, distance + 2).astype(int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                block = (f.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                order = np.lexsort((block, group))
                new = np.cumsum(np.concatenate([[False], (group[order][1:] != group[order][:-1]) | (block[order][1:] != block[order][:-1])]))
                found.append(compare(new, f[order], p[order]))
            return spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return compare(key, fp, probe)

    def compare(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = fp.view(np.uint64)
        us, vs = [], []
        alive = np.arange(len(key))
        step = 1
        while len(alive):
            alive = alive[alive + step < len(key)]
            alive = alive[key[alive] == key[alive + step]]
            near = alive[(np.bitwise_count(bits[alive] ^ bits[alive + step]) <= distance)
                         & ~(probe[alive] & probe[alive + step]) & (fp[alive] != fp[alive + step])]
            us.append(fp[near])
            vs.append(fp[near + step])
            step += 1
            if step % 64 == 0:  # large bucket: keep a spanning set of the links found so far
                u, v = spanning(np.concatenate(us), np.concatenate(vs))
                us, vs = [u], [v]
        return spanning(np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # rows of the last key may go on in the next batch
            if cut:
                u, v = settle([*held, tuple(c[:cut] for c in cols)])
                held = []
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            held.append(tuple(c[cut:] for c in cols))
        if held:
            u, v = settle(held)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (distinct.mapInArrow(emit, "key long, fp long, probe boolean")
            .repartition(n, "key").sortWithinPartitions("key").mapInArrow(link, "u long, v long"))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links u-v: at most one link less than there are ends."""
    if not len(u):
        return u, v
    ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(ends)))
    return ends[label[out]], ends[out]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """id_col, fp, component_id for each row of docs.

    Fingerprints that differ in at most distance bits are linked; component_id is the smallest id
    reachable over links, the row's own included. Null, empty and blank texts have fingerprint zero and
    are linked like any other; repeated ids are one document for component_id; a null id never is one,
    so a component of null ids alone has a null component_id. Copies are grouped by fingerprint before
    the search, never expanded into pairs.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("_least")), "fingerprint-classes")
    roots = connected_components(close_pairs(least.select("fp"), distance))
    roots = roots.select(F.col("vertex").alias("fp"), "root")
    linked = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = linked.join(by_root, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(id_col, "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with fingerprint (16 hex digits) and component_id; odd rows: see near_duplicates."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
