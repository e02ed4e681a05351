"""Language identification: n-gram presence kernels, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.llm.common import id_crc, table

SLOTS = 1 << 18
SALTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
UNKNOWN = "und"


def presence(text: str, longest: int = 3) -> np.ndarray:
    """Flags of the character n-grams (1 to longest) of the whole lower-case text, hashed to SLOTS places."""
    flags = np.zeros(SLOTS, dtype=bool)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    for i in range(0, len(c), 1 << 16):
        part = c[i:i + (1 << 16) + longest - 1]
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            h = h[:len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1:]
            flags[(h * SALTS[n]) >> np.uint32(14)] = True
    return flags


@dataclass
class LanguageModel:
    names: list[str]
    slots: np.ndarray      # places that some landmark has
    landmarks: np.ndarray  # slots x landmarks, 0 or 1 over the landmark's root size
    weights: np.ndarray    # landmarks x languages

    def margins(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest outputs of a batch, by two matrix products over its kernel rows."""
        x = np.zeros((len(texts), len(self.slots)), dtype=np.float32)
        size = np.ones(len(texts), dtype=np.float32)
        for i, t in enumerate(texts):
            f = presence(t)
            x[i] = f[self.slots]
            size[i] = max(np.count_nonzero(f), 1)
        return (x @ self.landmarks / np.sqrt(size)[:, None]) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        for at in range(0, len(known), 128):
            some = known[at:at + 128]
            m = self.margins([texts[i] for i in some]).astype(np.float64)
            best = m.argmax(axis=1)
            e = np.exp(3 * (m - m.max(axis=1, keepdims=True)))
            p = e[np.arange(len(some)), best] / e.sum(axis=1)
            for i, b, s in zip(some, best.tolist(), p.tolist(), strict=True):
                names[i], scores[i] = self.names[b], float(s)
        return names, scores


def fit(rows: list[tuple[str, str]], landmarks: int = 24, ridge: float = 1e-2) -> LanguageModel:
    """rows (text, language). The first `landmarks` rows of each language are landmarks."""
    names = sorted({y for _, y in rows})
    if not names:
        return LanguageModel([], np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0)))
    marks: list[int] = []
    for name in names:
        marks += [i for i, (_, y) in enumerate(rows) if y == name][:landmarks]
    flags = [presence(rows[i][0]) for i in marks]
    slots = np.flatnonzero(np.any(flags, axis=0))
    size = np.sqrt(np.array([max(f.sum(), 1) for f in flags], dtype=np.float32))
    l = np.stack([f[slots] for f in flags]).astype(np.float32) / size[:, None]
    values, vectors = np.linalg.eigh((l @ l.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm ** -1/2
    model = LanguageModel(names, slots, np.ascontiguousarray(l.T), np.eye(len(marks), dtype=np.float32))
    k = np.concatenate([model.margins([t for t, _ in rows[i:i + 128]]) for i in range(0, len(rows), 128)]).astype(np.float64)
    phi = k @ root
    y = np.array([[1.0 if b == name else -1.0 for name in names] for _, b in rows])
    weight = np.array([len(rows) / (len(names) * sum(c == b for _, c in rows)) for b in names])
    w = np.array([weight[names.index(b)] for _, b in rows])[:, None]
    solved = np.linalg.solve(phi.T @ (phi * w) + ridge * np.eye(phi.shape[1]), phi.T @ (y * w))
    model.weights = (root @ solved).astype(np.float32)
    return model


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4,
                 held_out: int = 2, rows_each: int = 300, max_chars: int = 20_000) -> LanguageModel:
    """Fit on at most rows_each rows of each language, by id hash, whose crc32(id) mod modulus isn't held_out.

    Training takes texts of max_chars characters at most, so that the sample has a bounded size; scoring reads whole texts.
    """
    ok = (id_crc(F.col(id_col)) % modulus != held_out) & F.col(lang_col).isNotNull() & F.length(text_col).between(1, max_chars)
    rows = docs.where(ok).select(id_col, F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    few = rows.select(F.col(id_col), "y", F.xxhash64("t").alias("h")).withColumn(
        "r", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit("l")), "h"))).where(F.col("r") <= rows_each)
    found = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(few.select(id_col, "y", "h", "r")), [id_col, "y", "h"]).dropDuplicates(["y", "r"]).select("y", "r", "t")
    return fit([(r[2], r[0]) for r in sorted(found.collect())])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language; 'und' for null texts and texts without a letter) and lang_score (0 to 1; 0 for und).

    Equal outputs give the language that comes first by name. Repeated rows are treated alike, texts of any length whole; an empty table
    gives an empty one, a model without languages 'und'; further columns pass through.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score")])  # such columns are replaced
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.slots, model.landmarks, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                lang, score = m.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, docs.withColumns({"lang_pred": F.lit("").cast("string"), "lang_score": F.lit(0.0)}).schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with held_out, lang_pred and score; odd rows: see identify."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
