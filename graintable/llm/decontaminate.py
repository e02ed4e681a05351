"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.llm.common import giving_back, materialize, table

TOKEN = re.compile(r"\w+")
#: Bits of the seed filter: 8 MB, whatever the benchmark's size. It only spares work; a fuller one lets more through.
FILTER_BITS = 26
BASE = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-case words of a text, in order."""
    import xxhash

    words = TOKEN.findall((text or "").lower())
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin value of every window of width tokens, modulo 2**64."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * BASE + tokens[i:i + n]
        out ^= out >> np.uint64(29)
        return out * BASE + np.uint64(width)


def running_hashes(tokens: np.ndarray, width: int, powers: dict[int, np.ndarray]) -> np.ndarray:
    """Karp-Rabin value of every window of width tokens, modulo 2**64, put together from windows of powers of two (kept in powers)."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, at = np.zeros(n, dtype=np.uint64), 0
        for bit in range(width.bit_length()):
            size = 1 << bit
            if size not in powers:
                half, shift = powers[size >> 1], pow(int(BASE), size >> 1, 1 << 64)
                powers[size] = half[:len(half) - (size >> 1)] * np.uint64(shift) + half[size >> 1:]
            if width & size:
                out = out * np.uint64(pow(int(BASE), size, 1 << 64)) + powers[size][at:at + n]
                at += size
        return out


def tile(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern position, text position, length) of non-overlapping common runs.

    The longest common run of unmarked tokens is marked again and again, down to runs of `least` tokens; ties go to the
    smaller pattern position, then the smaller text position. Its length is found by halving over window lengths, for each of
    which Karp-Rabin values of unmarked windows are compared; of one length all runs are marked in order before a shorter one is looked for.
    """
    free_p, free_t = np.ones(len(pattern), dtype=bool), np.isin(text, pattern)  # other tokens of the text are in no run
    powers_p, powers_t = {1: pattern}, {1: text}
    tiles: list[tuple[int, int, int]] = []

    def open_windows(free: np.ndarray, width: int) -> np.ndarray:
        if len(free) < width:
            return np.zeros(0, dtype=np.int64)
        run = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(run[width:] == run[:-width])

    def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unmarked windows of the pattern and of the text that occur on the other side, with their values."""
        p, t = open_windows(free_p, width), open_windows(free_t, width)
        hp, ht = running_hashes(pattern, width, powers_p)[p], running_hashes(text, width, powers_t)[t]
        p, hp = p[np.isin(hp, ht)], hp[np.isin(hp, ht)]
        keep = np.isin(ht, hp)
        return p, hp, t[keep], ht[keep]

    top = min(len(pattern), len(text))
    while top >= least:
        low, high, found = least, top, None
        while low <= high:
            middle = high if found is None and low == least and high == top and top <= 2 * least else (low + high) // 2
            here = common(middle)
            if len(here[0]):
                found, low = (middle, here), middle + 1
            else:
                high = middle - 1
        if found is None:
            return tiles
        width, (p, hp, t, ht) = found
        order = np.argsort(ht, kind="stable")
        values, first = np.unique(ht[order], return_index=True)
        ends = np.append(first[1:], len(order))
        next_of = {int(v): [int(a), int(b)] for v, a, b in zip(values, first, ends, strict=True)}
        for at, value in zip(p.tolist(), hp.tolist(), strict=True):
            if not free_p[at:at + width].all():
                continue
            place = next_of[value]
            while place[0] < place[1] and not free_t[t[order[place[0]]]:t[order[place[0]]] + width].all():
                place[0] += 1  # marks only grow: what isn't free now never is again
            if place[0] < place[1]:
                to = int(t[order[place[0]]])
                if (pattern[at:at + width] == text[to:to + width]).all():
                    free_p[at:at + width] = False
                    free_t[to:to + width] = False
                    tiles.append((at, to, width))
        top = width - 1
    return tiles


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """One bit for the lower FILTER_BITS bits of each seed, set in the executors in pieces of 64 KB that are or-ed by piece."""
    piece = 16  # bits of a byte's number within its piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        for b in batches:
            s = b.column(0).to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            np.bitwise_or.at(bits, (s >> np.uint64(3)).astype(np.int64), np.left_shift(1, (s & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        rows = bits.reshape(-1, 1 << piece)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], ["piece", "bits"])

    def either(key: tuple, parts: pa.Table) -> pa.Table:
        whole = np.zeros(1 << piece, dtype=np.uint8)
        for x in parts.column("bits"):
            whole |= np.frombuffer(x.as_buffer(), dtype=np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros((1 << (FILTER_BITS - 3 - piece), 1 << piece), dtype=np.uint8)
    for r in seeds.select("seed").mapInArrow(run, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").collect():
        out[r[0]] = np.frombuffer(r[1], dtype=np.uint8)
    return out.reshape(-1)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", least: int = 5, coverage: float = 0.5) -> DataFrame:
    """(id_col, item_col, n_tokens, covered, coverage, tiles) of each document and test item that it covers.

    A document covers an item when tiles of at least `least` tokens (or the whole item, if that is shorter)
    hold at least the share `coverage` of the item's tokens; passages may be reordered. Whole texts are
    searched. Null or wordless texts and items match nothing; empty tables give an empty table; repeated
    documents or items (same id and text) count once, different texts under one id each count. If both id columns have one
    name, the item's is called item_<name>. Other columns are not read.

    A pair is tiled only if its shared seeds could cover enough. An item leaves out its most frequent seeds as long
    as any document that can cover it still has another one, so a run that very many documents and items hold makes no pairs.
    """
    spark = docs.sparkSession
    item_out = item_col if item_col != id_col else f"item_{item_col}"
    item_type = benchmark.schema[item_col].dataType.simpleString()
    id_type = docs.schema[id_col].dataType.simpleString()

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = [token_hashes(x.as_py()) for x in b.column(1)]
            found = [np.unique(window_hashes(t, min(least, len(t))), return_counts=True) for t in toks]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.tobytes() for t in toks], pa.binary()), pa.array([min(least, len(t)) for t in toks], pa.int32()), pa.array([len(t) for t in toks], pa.int32()),
                 pa.array([v.view(np.int64).tolist() for v, _ in found], pa.list_(pa.int64())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int64()))],
                ["_item", "item_tokens", "width", "size", "seeds", "times"])

    tests = benchmark.select(F.col(f"`{item_col}`").alias("_item"), F.col(f"`{item_text}`").alias("_t")).where("_t is not null").distinct()
    tests = materialize(tests.mapInArrow(items, f"_item {item_type}, item_tokens binary, width int, size int, seeds array<long>, times array<long>").where("width > 0")
                        .withColumn("_key", F.xxhash64("_item", "item_tokens")), "decon-items")
    # windows of an item that its document must share at least: each covers no more than its width of tokens
    seeds = tests.select("_key", F.ceil(F.lit(coverage) * F.col("size") / F.col("width")).alias("needed"), F.explode(F.arrays_zip("seeds", "times")).alias("x"))
    seeds = materialize(seeds.select("_key", "needed", F.col("x.seeds").alias("seed"), F.col("x.times").alias("times")), "decon-seeds")
    widths = sorted(r[0] for r in tests.select("width").distinct().collect())  # at most `least` values
    shared = spark.sparkContext.broadcast(seed_filter(seeds))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows: list[tuple] = []
                for i, text in enumerate(b.column(1)):
                    tokens = token_hashes(text.as_py())
                    hits = []
                    for w in widths:
                        h = window_hashes(tokens, w)
                        s = (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                        hits.append(h[(seen[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1])
                    hits = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.uint64)
                    if len(hits):
                        rows.append((b.column(0)[i].as_py(), tokens.tobytes(), hits.view(np.int64).tolist()))
                if rows:
                    ids, toks, hits = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, whole.schema.field(0).type), pa.array(toks, pa.binary()), pa.array(hits, pa.list_(pa.int64()))], ["_id", "tokens", "hits"])

    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t")).where("_t is not null")
    near = materialize(source.mapInArrow(giving_back(search), f"_id {id_type}, tokens binary, hits array<long>")
                       .withColumn("_doc", F.xxhash64("_id", "tokens")), "decon-hits").dropDuplicates(["_doc"])
    hits = near.select("_doc", F.explode("hits").alias("seed"))
    spread = hits.groupBy("seed").agg(F.count("*").alias("docs"))
    ranked = seeds.join(spread, "seed").withColumn("_up", F.sum("times").over(Window.partitionBy("_key").orderBy(F.desc("docs"), "seed")))  # an item's own seeds
    probes = ranked.where(F.col("_up") >= F.col("needed"))
    pairs = materialize(hits.join(probes.select("seed", "_key"), "seed").select("_doc", "_key").distinct(), "decon-pairs")
    both = (pairs.join(near.select("_doc", "_id", "tokens"), "_doc")
            .join(tests.select("_key", "_item", "item_tokens"), "_key").select("_id", "_item", "tokens", "item_tokens"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n, covered, where = [], [], [], []
            for i in range(b.num_rows):
                p = np.frombuffer(b.column(3)[i].as_py(), dtype=np.uint64)
                t = np.frombuffer(b.column(2)[i].as_py(), dtype=np.uint64)
                found = tile(p, t, min(least, len(p)))
                have = sum(x[2] for x in found)
                if have >= coverage * len(p):
                    keep.append(i)
                    n.append(len(p))
                    covered.append(have)
                    where.append(len(found))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int64()), pa.array(covered, pa.int64()),
                 pa.array([c / k for c, k in zip(covered, n, strict=True)], pa.float64()), pa.array(where, pa.int64())],
                ["_id", "_item", "n_tokens", "covered", "coverage", "tiles"])

    found = both.mapInArrow(tiles, f"_id {id_type}, _item {item_type}, n_tokens long, covered long, coverage double, tiles long")
    return found.withColumnsRenamed({"_id": id_col, "_item": item_out})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents that cover items of benchmark, one row a pair; odd rows: see contaminated."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
