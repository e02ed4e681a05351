"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.llm.common import bounded_sample, id_crc, one_text, table

#: Byte classes: lower letters, upper letters, digits, space, line end, full stop, comma, bar, other marks, bytes above ASCII.
CLASSES = 10
_CLASS = np.full(256, 8, dtype=np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3), (b"\n\r", 4), (b".!?", 5), (b",;:", 6), (b"|", 7)):
    _CLASS[np.frombuffer(_chars, dtype=np.uint8)] = _k
_CLASS[128:] = 9
_TO_CLASS = _CLASS.tobytes()
PAIRS = 1024
STEPS = 12
TERMS = CLASSES ** 3 + PAIRS + 4 * STEPS


def term_counts(text: str | None) -> np.ndarray:
    """Term counts of a whole text: class trigrams (runs of one class count once), hashed letter pairs, and binned
    shares of repeated words, distinct words, marks and mean word length."""
    out = np.zeros(TERMS, dtype=np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    c = np.frombuffer(data.translate(_TO_CLASS), dtype=np.uint8)
    runs = c[np.concatenate([[True], c[1:] != c[:-1]])].astype(np.int32)
    if len(runs) >= 3:
        out[:CLASSES ** 3] = np.bincount(runs[:-2] * CLASSES * CLASSES + runs[1:-1] * CLASSES + runs[2:], minlength=CLASSES ** 3)
    pair = (raw[:-1].astype(np.uint32) * 31 + raw[1:]) * np.uint32(0x9E3779B1) >> np.uint32(22)
    out[CLASSES ** 3:CLASSES ** 3 + PAIRS] = np.bincount(pair, minlength=PAIRS)
    words = data.lower().split()
    n = len(words)
    at = CLASSES ** 3 + PAIRS
    if n:
        marks = float((c >= 7).sum() - (c == 9).sum()) / len(c)
        shares = (sum(map(eq, words, words[1:])) / n, len(set(words)) / n, min(4 * marks, 1.0), min(len(data) / n / 24, 1.0))
        for i, x in enumerate(shares):
            out[at + i * STEPS + min(int(x * STEPS), STEPS - 1)] = 8.0
    return out


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray     # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length 1
    labels: np.ndarray
    weight: np.ndarray   # of each labelled row's vote
    prior: float
    power: float = 8.0

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None], neighbours: int = 15) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors, by exact cosine products of the block.

        Of equally near ones at the border those that come first count. A vote is the similarity, sharpened by a power, times its label's weight.
        """
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        counts = np.stack([term_counts(t) for t in texts])
        cos = self.embed(counts) @ self.vectors.T
        k = min(neighbours, cos.shape[1])
        edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1:k]
        near, ties = cos > edge, cos == edge
        near |= ties & (np.cumsum(ties, axis=1) <= k - near.sum(axis=1, keepdims=True))
        at = np.nonzero(near)[1]  # k of each row, in order
        at = at.reshape(len(texts), k)
        sim = np.maximum(np.take_along_axis(cos, at, axis=1), 0.0).astype(np.float64) ** self.power * self.weight[at]
        total = sim.sum(axis=1)
        return np.where(total > 1e-12, (sim * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)


def fit(rows: list[tuple[str | None, int]], dimensions: int = 48) -> QualityModel:
    """Latent-semantic axes (idf-weighted, truncated SVD) and vectors of the labelled rows; each label's votes weigh as much in all."""
    if not rows:
        return QualityModel(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.5)
    counts = np.stack([term_counts(t) for t, _ in rows])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.3)
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :min(dimensions, len(rows))]).astype(np.float32)
    y = np.array([1.0 if v == 1 else 0.0 for _, v in rows])
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    model = QualityModel(idf, axes, np.zeros((0, 0)), y, weight, float(share))
    model.vectors = model.embed(counts).astype(np.float32)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                held_out_mod: int = 5, sample_rows: int = 3000, max_chars: int = 50_000) -> QualityModel:
    """Fit on at most sample_rows labelled rows whose crc32(id) mod held_out_mod isn't 0, up to half of them of label 0.

    Training rows have max_chars characters at most, so that the sample has a bounded size; scoring reads whole texts. An id is one
    row: of several labels the least counts, of several texts the one with the least hash.
    """
    known = labels.where(id_crc(F.col(id_col)) % held_out_mod != 0).where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"))
    half = sample_rows // 2
    picked = bounded_sample(known.where("_y = 0"), id_col, half).unionByName(bounded_sample(known.where("_y = 1"), id_col, half))
    short = one_text(docs.join(F.broadcast(picked.select(id_col)), id_col, "left_semi"), id_col, text_col, max_chars)
    rows = short.join(F.broadcast(picked), id_col).select("_t", "_y").collect()
    return fit(sorted(((r[0], int(r[1])) for r in rows), key=lambda r: (r[0] or "", r[1])))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", neighbours: int = 15) -> DataFrame:
    """docs with quality_score (double, 0 to 1). Null and empty texts are scored as a text without terms: the labelled share of 1.

    Repeated rows are scored alike, texts of any length whole; an empty table gives an empty one; further columns pass through.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("quality_score",)])  # such columns are replaced
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.axes, model.vectors, model.labels, model.weight, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = QualityModel(*shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                s = m.scores(b.column(at).to_pylist(), neighbours)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(s, 0.0, 1.0), pa.float64())], [*names, "quality_score"])

    return docs.mapInArrow(run, docs.withColumn("quality_score", F.lit(0.0)).schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with held_out, score and predicted (0.3 or more); odd rows: see score_quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
