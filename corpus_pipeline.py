"""A corpus clean-up in five stages, each an operator of graintable.llm over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.llm.common import materialize, table
from graintable.llm.decontaminate import contaminated
from graintable.llm.line_dedup import dedup_lines
from graintable.llm.pieces import encode
from graintable.llm.simhash import near_duplicates
from graintable.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model is fit on the labelled rows of the input tables.

    Null and empty texts stay, repeated rows go or stay together; an empty table gives an empty one.
    """
    model = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("tox_score < 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; a document with nothing left goes too.

    Null and blank texts stay as they are. n_chars is that of the text that is left.
    """
    done = dedup_lines(docs)
    left = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    kept = done.where((F.col("n_dropped_") == 0) | left)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays; rows without an id stay.

    Equal rows (id and text) become one. An id that stands for several texts goes or stays as a whole: it is one document.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.dropDuplicates(["doc_id", "text"]).join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a test item's tokens or more go, with all rows of their id. Null and empty texts cover nothing and stay."""
    hits = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each kept document (little-endian unsigned 32-bit), their number, and whether they decode to its text."""
    return encode(docs, check=True).select("doc_id", "n_pieces", "ids", F.crc32("ids").alias("ids_crc32"), "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the learned grammar, the string tiling and the piece lattice; tests hold each stage to a plain computation on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
