"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, as spark.checkpoint.dir names it; only a local session may do without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/graintable-work"
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/graintable/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, column: str, tag: str) -> DataFrame:
    """As materialize(), in buckets by column, so that a grouping or join by it reads the rows where they are and shuffles the other side only."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = f"graintable_{path.rpartition('-')[2]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, column).option("compression", "zstd").option("path", path).saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved from here on: the frame keeps the files and their buckets, the catalog needs no entry
    spark.sql(f"DROP TABLE {name}")
    return found


def id_crc(col: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def bounded_sample(df: DataFrame, id_col: str, limit: int, seed: str = "s") -> DataFrame:
    """At most limit rows, chosen by a hash of the id (the same rows for the same input): for fitting models only."""
    return df.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.col(id_col)).limit(limit)


def one_text(docs: DataFrame, id_col: str, text_col: str, max_chars: int) -> DataFrame:
    """id_col, _t: one text an id among those of at most max_chars characters, that with the least hash; an id that is repeated very often stays one row."""
    rows = docs.select(id_col, F.col(text_col).alias("_t")).where(F.coalesce(F.length("_t"), F.lit(0)) <= max_chars)
    return rows.groupBy(id_col).agg(F.min(F.struct(F.xxhash64("_t"), F.col("_t"))).alias("_x")).select(id_col, F.col("_x._t").alias("_t"))


def release() -> None:
    """Give what a worker has freed back to the system: workers live on, and others of their executor need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and release() at its end."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole
