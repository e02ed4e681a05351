"""Groups of arrivals that are complete once nothing more has come for a while, by timers of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

OPEN = StructType([StructField(n, LongType()) for n in ("start", "last", "n")])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Arrivals(StatefulProcessor):
    """Keeps a key's open group (first and last time in microseconds, rows) and gives it out when the clock is a pause behind its last batch of rows."""

    def __init__(self, names: list[str], pause: int):
        self.names, self.pause = names, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        times = [r["_at"] for r in rows]
        old = self.group.get() if self.group.exists() else (min(times), max(times), 0)
        self.group.update((min([old[0], *times]), max([old[1], *times]), old[2] + len(times)))
        due = -(-(timerValues.getCurrentProcessingTimeInMs() * 1000 + self.pause) // 1000)
        before = {t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()}
        for t in before - {due}:
            self.handle.deleteTimer(t)
        if due not in before:
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        group = self.group.get() if self.group.exists() else None
        self.group.clear()
        return iter([] if group is None else [Row(**dict(zip(self.names, [*key, *group], strict=True)))])

    def close(self) -> None:
        pass


def complete_groups(stream: DataFrame, ts: str, pause: str, by: str, delay: str = "0 seconds", clock: str = "event") -> DataFrame:
    """by, start, last, n of a stream's groups of rows with a key, each given out once, when no row of the key has come for `pause`.

    clock: "event" for the rows' own times against the watermark (the newest time less delay), "arrival" for the time they come. By event time the groups are session
    windows: a row that comes `pause` or later after its key's last one begins a new group, one that comes late may still join two open groups, and one that is a
    pause or more behind the watermark is dropped. Rows without a key or time are left out; equal rows count each. Open groups are kept in the
    checkpoint, so a run that goes on from it gives out no group twice and loses none.
    """
    if clock not in ("event", "arrival"):
        raise ValueError(f"clock is event or arrival, not {clock}")
    timed = stream.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    micros = lambda x: round(stream.sparkSession.sql(f"SELECT CAST(INTERVAL {x} AS INTERVAL SECOND) AS s").first()["s"].total_seconds() * 1_000_000)
    if clock == "event":
        # a group of any number of rows is one row of state and a key's groups are merged in order, while timers would call on each group again. Session windows join at a
        # distance of exactly their gap too: on a time axis twice as long the gap can end between two microseconds
        rows = timed.withColumn("_at", F.timestamp_micros(F.unix_micros(ts) * 2)).withWatermark("_at", f"{2 * micros(delay)} microseconds")
        found = rows.groupBy(by, F.session_window("_at", f"{2 * micros(pause) - 1} microseconds")).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))
        return found.select(by, "start", "last", "n")
    rows = timed.select(by, F.unix_micros(ts).alias("_at"))
    schema = StructType([rows.schema[by], *OPEN.fields])
    found = rows.groupBy(by).transformWithState(Arrivals(schema.names, micros(pause)), schema, "Append", "ProcessingTime")
    return found.select(by, F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "n")


@contextmanager
def keyed_state(spark: SparkSession):
    """While it holds, streams that start keep their state in RocksDB, as timers and list state ask for; the setting before comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
