"""A table of keyed rows that grows by batches: a batch writes its own new rows and reads of the table only what its keys may be in."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.operators.relational import assign_ids, first_per_key
from graintable.sources.files import materialize, remove
from graintable.streaming.incremental import for_each

#: Bits of a slot of the filter (what Spark's bitmap functions hold in one value), and how many of them a key sets.
SLOT_BITS = 32_768
PROBES = 4


class KeyedTable:
    """Rows with a key and a number, in buckets of the key's hash, with a Bloom filter in slots of those buckets.

    A batch's keys are looked up in the slots they fall in; only those that the filter may have are compared with the stored keys of their
    buckets, the others are new for certain. New rows are appended under a commit of their own with the slots they
    touch, so what a batch writes follows the batch. A commit counts once its line is in the log: readers see it as a whole, a batch
    that failed half-way leaves nothing that is read, and a label that was committed is not merged again. compact() puts all commits into one.
    `slots` is fixed with the table: about 3,000 keys a slot keep false alarms, which only cost a comparison, at some 1 in 90. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, id_col: str = "id", slots: int = 4096, buckets: int = 64):
        self.spark, self.path, self.key, self.id_col, self.slots, self.buckets = spark, path.rstrip("/"), key, id_col, slots, buckets

    # -- the log

    def commits(self) -> list[dict]:
        """Commits that count, oldest first: what the last compaction left and all after it."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        lines = sorted((json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/_log").collect()), key=lambda x: x["n"])  # a line a batch
        start = max((i for i, x in enumerate(lines) if x["whole"]), default=0)
        return lines[start:]

    def _log(self, name: str, labels: list[str], top: int, whole: bool) -> None:
        n = max((x["n"] for x in self.commits()), default=0) + 1
        line = json.dumps({"n": n, "name": name, "labels": labels, "top": top, "whole": whole})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_log")

    # -- the rows

    def _hashed(self, df: DataFrame) -> DataFrame:
        """With _slot, bucket and _bits, the positions of the key in its slot."""
        h = F.xxhash64(F.lit("bits"), F.col(self.key))
        slot = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.slots)).cast("int")
        places = F.array(*[F.shiftrightunsigned(h, 15 * i).bitwiseAND(SLOT_BITS - 1) for i in range(PROBES)])
        return df.withColumns({"_slot": slot, "_bits": places}).withColumn("bucket", (F.col("_slot") % self.buckets).cast("int"))

    def _stored(self, what: str, names: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows or filter slots of commits; commit and bucket are folders, so the others are not listed as data."""
        df = self.spark.read.parquet(f"{self.path}/{what}").where(F.col("commit").isin(list(names)))
        return df if buckets is None else df.where(F.col("bucket").isin(list(buckets)))

    def read(self) -> DataFrame | None:
        """All rows that count; None before the first commit."""
        names = [x["name"] for x in self.commits() if x["name"]]
        return self._stored("rows", names).drop("commit", "bucket") if names else None

    def may_have(self, keyed: DataFrame, names: Sequence[str], buckets: Sequence[int]) -> DataFrame:
        """The rows of keyed (see _hashed) whose key some commit's filter has; a row stays one row."""
        slots = self._stored("filter", names, buckets).select("_slot", "bitmap")
        byte = lambda p: F.conv(F.hex(F.substring("bitmap", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = reduce(lambda a, b: a & b, [F.call_function("shiftright", byte(F.col("_bits")[i]), (F.col("_bits")[i] % 8).cast("int")).bitwiseAND(1) == 1 for i in range(PROBES)])
        found = keyed.select(self.key, "_slot", "_bits").join(slots, "_slot").where(hit).select(F.col(self.key).alias("_hit")).distinct()
        return keyed.join(found, F.col(self.key) == F.col("_hit"), "left_semi")

    def merge(self, batch: DataFrame, order: str, label: str | None = None) -> int:
        """Append the batch's rows with keys the table doesn't have, the first of each by order, numbered on in that order; returns how many.

        Rows without a key are rows of their own and are all appended. The batch has the table's columns but for its number. A label that was
        committed before adds nothing.
        """
        log = self.commits()
        if label is not None and any(label in x["labels"] for x in log):
            return 0
        names, top = [x["name"] for x in log if x["name"]], max((x["top"] for x in log), default=0)
        keyed = self._hashed(first_per_key(batch.where(F.col(self.key).isNotNull()), [self.key], [F.col(order)]))
        fresh = keyed
        if names:
            keyed = materialize(keyed, "keyed-batch")
            buckets = [r[0] for r in keyed.select("bucket").distinct().collect()]  # as many as the table has at most
            maybe = materialize(self.may_have(keyed, names, buckets).select(self.key, "bucket"), "keyed-maybe")
            in_question = [r[0] for r in maybe.select("bucket").distinct().collect()]
            known = maybe.join(self._stored("rows", names, in_question).select(self.key, "bucket"), [self.key, "bucket"], "left_semi")
            fresh = keyed.join(known.select(self.key), self.key, "left_anti")
        bare = batch.where(F.col(self.key).isNull()).withColumns({"_slot": F.lit(None).cast("int"), "_bits": F.lit(None).cast("array<bigint>"), "bucket": F.lit(0)})
        empty = self.spark.createDataFrame([], "id long")
        new = materialize(assign_ids(fresh.unionByName(bare), empty, "id", order, "_number").withColumn(self.id_col, F.col("_number") + top).drop("_number"), "keyed-new")
        added = new.count()
        if added:
            self._write(new, new.where("_slot is not null"), [label] if label is not None else [], top + added, False)
        elif label is not None:
            self._log("", [label], top, False)
        return added

    def _write(self, rows: DataFrame, keyed: DataFrame, labels: list[str], top: int, whole: bool) -> None:
        name = f"c{uuid.uuid4().hex}"
        filtered = keyed.select("bucket", "_slot", F.explode("_bits").alias("_bit")).groupBy("bucket", "_slot").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))
        rows.drop("_slot", "_bits").withColumn("commit", F.lit(name)).repartition("bucket").write.mode("append").partitionBy("commit", "bucket").parquet(f"{self.path}/rows")
        filtered.withColumn("commit", F.lit(name)).repartition("bucket").write.mode("append").partitionBy("commit", "bucket").option("compression", "zstd").parquet(f"{self.path}/filter")
        self._log(name, labels, top, whole)

    def compact(self) -> None:
        """Put all commits into one; labels stay known."""
        log = self.commits()
        names = [x["name"] for x in log if x["name"]]
        if len(names) < 2:
            return
        rows = self._stored("rows", names).drop("commit", "bucket")
        hashed = self._hashed(rows).withColumn("bucket", F.coalesce("bucket", F.lit(0)))
        self._write(hashed, hashed.where(F.col(self.key).isNotNull()), sorted({x for c in log for x in c["labels"]}), max(x["top"] for x in log), True)
        for name in names:
            remove(self.spark, f"{self.path}/rows/commit={name}")
            remove(self.spark, f"{self.path}/filter/commit={name}")

    def merge_stream(self, stream: DataFrame, order: str, checkpoint: str) -> None:
        """Merge all that a stream has now; it goes on from its checkpoint, and a micro-batch that is run again is known by its label."""
        for_each(stream, checkpoint, lambda df, n: self.merge(df, order, f"{checkpoint}:{n}"))

