"""Incremental jobs: file streams with overlap and dedup, ledgers, batch merges, sessions and period counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.operators.relational import assign_ids, first_per_key
from graintable.sources.files import current, overwrite_atomic, work_path


def since(last_run: str | None, now: str, overlap_days: int = 1, first_days: int = 14):
    """The pull's start as a column: the last run less the overlap; first_days before now on a first run."""
    if last_run is None:
        return F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(first_days))
    return F.lit(last_run).cast("timestamp") - F.make_dt_interval(F.lit(overlap_days))


def incremental(df: DataFrame, ts: str, key: str, delay: str = "1 day") -> DataFrame:
    """A stream's first row of each key within the watermark; a batch frame's first row of each key."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming:
        return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return first_per_key(timed, [key], [F.col(ts)])


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet under path (with its checkpoint), and read the result."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def for_each(stream: DataFrame, path: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Run batch(frame, id) on every micro-batch of what is there."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def dedup_content(df: DataFrame, text: str, least: int, order: str, reserved: DataFrame | None = None) -> DataFrame:
    """The first row (by order) of each trimmed text of at least `least` characters; ids in reserved(order) are skipped."""
    ok = df.where(F.length(F.trim(text)) >= least)
    if reserved is not None:
        ok = ok.join(reserved.select(order), order, "left_anti")
    return first_per_key(ok.withColumn("_h", F.md5(F.trim(text))), ["_h"], [F.col(order)]).drop("_h")


def pending(df: DataFrame, ledger: DataFrame, key: str, retry: bool = True) -> DataFrame:
    """Rows whose key the ledger(key, status) doesn't have as done; failed ones come again if retry is set."""
    done = ledger.where("status = 'done'") if retry else ledger
    return df.join(done.select(key), key, "left_anti")


def reset_failed(ledger: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The ledger without keys that are marked done but have no result."""
    return ledger.join(results.select(key), key, "left_semi").unionByName(ledger.where("status <> 'done'").join(results.select(key), key, "left_anti"))


def merge_batch(base: DataFrame, batch: DataFrame, key: str, id_col: str, order: str) -> DataFrame:
    """base and the batch's new keys (first of each), numbered on from base's ids; rows without a key are rows of their own and all stay.

    The whole table is read and given back; KeyedTable (streaming.keyed) grows by what a batch adds.
    """
    fresh = first_per_key(batch.where(F.col(key).isNotNull()).join(base.select(key), key, "left_anti"), [key], [F.col(order)])
    fresh = fresh.unionByName(batch.where(F.col(key).isNull()))
    return base.unionByName(assign_ids(fresh, base, id_col, order, id_col), allowMissingColumns=True)


def merge_arrivals(spark: SparkSession, arrivals: Sequence[DataFrame], table_path: str, key: str, id_col: str, order: str) -> None:
    """Each arrival's files as micro-batches of one stream, merged into the table's current version, from which the next one goes on.

    The stream runs after each arrival and goes on from its checkpoint; a micro-batch that is run again after a failure
    finds its keys in the table and adds nothing.
    """
    path = work_path(spark, "merge-in")

    def add(batch: DataFrame, n: int) -> None:
        overwrite_atomic(merge_batch(current(spark, table_path), batch, key, id_col, order), table_path)

    for df in arrivals:
        df.write.mode("append").parquet(f"{path}/in")
        for_each(spark.readStream.schema(df.schema).parquet(f"{path}/in"), path, add)


def sessions(df: DataFrame, ts: str, gap: str, by: str, delay: str | None = None) -> DataFrame:
    """by, start, stop, n: runs of rows with no pause of `gap` or longer."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark(ts, delay or "1 hour")
    return timed.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def per_period(df: DataFrame, ts: str, period: str, delay: str = "1 day") -> DataFrame:
    """start, n of each tumbling window."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, period).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def staged(spark: SparkSession, df: DataFrame, tag: str) -> tuple[str, DataFrame]:
    """df written to the shared folder as a stream's source: the work folder and the stream over it."""
    path = work_path(spark, tag)
    df.write.parquet(f"{path}/in")
    return path, spark.readStream.schema(df.schema).parquet(f"{path}/in")
