"""Ranked lexical search: an Aho-Corasick automaton of all items' terms scans the documents' texts, without an index of them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.llm.common import giving_back, reachable, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term: digits, ASCII letters and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: For UTF-8 bytes: A-Z lower-cased, what is part of no term becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Partial results of so many groups of tasks meet before an item's own do.
SALTS = 64
#: Scores that a task holds at once.
CELLS = 2_000_000


@dataclass
class Items:
    """A block of items: terms by number, and for each term the items that hold it (flat, from start[term] to start[term + 1]) and how often."""

    ids: pa.Array
    terms: list[str]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray

    def automaton(self):
        """Terms between spaces, as the bytes of their UTF-8: a term is found where it is whole."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            found.add_word(f" {term.encode().decode('latin-1')} ", i)
        found.make_automaton()
        return found

    def scores(self, terms: np.ndarray, points: np.ndarray) -> np.ndarray:
        """For each item the sum of its terms' points, repeats included."""
        size = self.start[terms + 1] - self.start[terms]
        at = np.arange(size.sum()) + np.repeat(self.start[terms] - np.cumsum(size) + size, size)
        each = np.repeat(points, size) * self.times[at]
        if float(each.sum(dtype=np.float64)) < 2**53:  # then doubles add up exactly
            return np.bincount(self.item[at], weights=each, minlength=len(self.ids)).astype(np.int64)
        out = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(out, self.item[at], each)
        return out


def folded(text: bytes | None) -> tuple[int, str]:
    """The number of a text's terms, and the terms between spaces (a character for each byte)."""
    if not text:
        return 0, ""
    low = text.translate(FOLD)
    inside = np.frombuffer(low, dtype=np.uint8) != 32
    n = int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    return n, f" {low.decode('latin-1')} "


def hits(automaton, text: str) -> Counter:
    return Counter(map(itemgetter(1), automaton.iter(text)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_item, _term, _times: an id's terms over its different texts; rows without an id or without a term don't count."""
    once = items.select(F.col(id_col).alias("_item"), F.col(text_col).alias("_x")).where("_item is not null and _x is not null").distinct()
    return (once.select("_item", F.explode(F.regexp_extract_all(F.translate("_x", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("_term"))
            .groupBy("_item", "_term").agg(F.count("*").alias("_times")))


def load(rows: list, kind: pa.DataType) -> Items:
    """A block's rows (item, term, times) as Items."""
    ids, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    item_at, term_at = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(terms)}
    t = np.array([term_at[r[1]] for r in rows])
    order = np.argsort(t, kind="stable")
    return Items(pa.array(ids, kind), terms, np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(terms)))]),
                 np.array([item_at[r[0]] for r in rows])[order], np.array([r[2] for r in rows], dtype=np.int64)[order])


def corpus_counts(texts: DataFrame, shared: Broadcast) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all documents' terms with repeats, and for each term of the block how many documents hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        automaton, found, n, length = block.automaton(), np.zeros(len(block.terms), dtype=np.int64), 0, 0
        for b in batches:
            for x in b.column(0).cast(pa.binary()):
                terms, text = folded(x.as_py())
                n, length = n + (terms > 0), length + terms
                found[list(hits(automaton, text))] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, length], found[some]]))], ["term", "n"])

    sums = {r["term"]: r["n"] for r in texts.mapInArrow(giving_back(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # two more than the block's terms
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(len(shared.value.terms))], dtype=np.int64)


class Best:
    """The k best documents of each item so far: by score, then the smaller id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.item, self.score, self.id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.nulls(0)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: a row for each of ids."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[row, item[len(self.item):]]])
        new = ids.take(pa.array(row))
        ids = pa.concat_arrays([self.id, new]) if len(self.id) else new
        known = ids.drop_null().to_numpy(zero_copy_only=False)
        place = np.full(len(ids), len(known))
        place[ids.is_valid().to_numpy(zero_copy_only=False)] = np.unique(known, return_inverse=True)[1] if len(known) else 0
        order = np.lexsort((place, -score, item))
        sorted_item = item[order]
        first = np.searchsorted(sorted_item, sorted_item)
        kept = order[np.arange(len(order)) - first < self.k]
        self.item, self.score, self.id = item[kept], score[kept], ids.take(pa.array(kept))
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) >= self.k)
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def ranked_block(docs: DataFrame, shared: Broadcast, n_docs: int, length: int, weights: np.ndarray, k: int, schema: object) -> DataFrame:
    """_item, _score, _doc: of each partition of docs (id, text) the k best documents of each item of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        automaton, best = block.automaton(), Best(len(block.ids), k)
        rows = max(1, CELLS // len(block.ids))
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            for at in range(0, b.num_rows, rows):
                some = texts.slice(at, rows)
                scores = np.zeros((len(some), len(block.ids)), dtype=np.int64)
                for i, x in enumerate(some):
                    n, text = folded(x.as_py())
                    found = hits(automaton, text)
                    if found:
                        terms, tf = np.fromiter(found.keys(), dtype=np.int64), np.fromiter(found.values(), dtype=np.int64)
                        m = 100 - 75 + 75 * n * n_docs // length
                        scores[i] = block.scores(terms, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m)))
                best.add(scores, ids.slice(at, rows))
        if len(best.item):
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(best.item)), pa.array(best.score), best.id], ["_item", "_score", "_doc"])

    return docs.mapInArrow(giving_back(run), schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = 200_000) -> DataFrame:
    """item_col, rank (int, from 1), id_col, score (long): the k documents that match each item best, with a score above 0.

    A term is a run of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased. An item's score for a document is the sum over its terms,
    repeats included, of w * (10^9 tf div (1000 tf + 8 m)) in whole numbers: tf its occurrences in the document, w = floor(1000 ln((2N + 2) / (2df + 1))),
    m = 25 + 75 n N div L, with N documents that have a term, L terms in all, n in the document, df documents with the term.
    Equal scores go by the smaller document id, null ids last.

    The items' terms form one automaton, which is broadcast; it scans whole texts twice, for the counts and for the scores, and what it finds maps
    to items, so neither an index of documents nor a row a match is written: a task gives a number for each term, then k rows for each item. Items
    whose terms number more than block_terms in all are taken in blocks of about that many, each with a scan of its own, so what is
    broadcast is bounded (one item's terms stay together).

    Null and empty texts have no terms. Repeated rows of docs are documents of their own; repeated rows of items count once, different texts of
    one item id add up, null item ids take no part. Other columns are not read. An empty table gives no rows. Ids that aren't whole numbers are compared as strings.
    """
    reachable(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    plain = "long" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    rows = docs.select(F.col(id_col).cast(plain).alias("_doc"), F.col(text_col).alias("_text"))
    terms = item_terms(items, item_col, item_text)
    total = terms.count()
    blocks = max(1, math.ceil(total / block_terms))
    schema = terms.select("_item", F.lit(0).cast("long").alias("_score"), F.lit(None).cast(plain).alias("_doc")).schema
    out = spark.createDataFrame([], schema)
    item_kind = terms.select("_item").limit(0).toArrow().schema.field(0).type
    for i in range(blocks if total else 0):
        held = terms.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == i).collect()  # about block_terms rows
        if not held:
            continue
        shared = spark.sparkContext.broadcast(load(held, item_kind))
        n_docs, length, df = corpus_counts(rows.select("_text"), shared)
        if not n_docs:
            break
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        out = out.unionByName(ranked_block(rows, shared, n_docs, length, weights, k, schema))
    order = [F.col("_score").desc(), F.asc_nulls_last("_doc")]
    for keys in (["_item", "_salt"], ["_item"]):
        if len(keys) > 1:
            out = out.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    return out.select(F.col("_item").alias(item_col), F.col("_rank").alias("rank"), F.col("_doc").cast(kind).alias(id_col), F.col("_score").alias("score"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item; odd rows: see search."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY k, term),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
p AS (SELECT t.k, t.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(d.terms) * big_n) // big_l))) AS points FROM t JOIN w USING (term) JOIN d ON d.k = t.k, s WHERE t.term IN (SELECT term FROM i)),
g AS (SELECT item_id, k, CAST(sum(times * points) AS BIGINT) AS score FROM p JOIN i USING (term) GROUP BY item_id, k)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM g JOIN d USING (k) WHERE score > 0) WHERE rank <= 10"""
