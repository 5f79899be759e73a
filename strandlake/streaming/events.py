"""Event streams: windows, sessions, deduplication, count-triggered shards.  Time columns are UTC timestamps."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def as_events(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_stream(spark: SparkSession, path: str, schema, ts: str = "ts", late: str = "10 minutes", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return as_events(reader.parquet(path), ts).withWatermark(ts, late)


def windowed(df: DataFrame, keys: list[str], length: str, slide: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """(start, keys, n, total) of tumbling or sliding windows; batch and stream alike."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    w = F.session_window(ts, gap)
    return df.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def count_shards(df: DataFrame, key: str, ts: str, order: str, size: int) -> DataFrame:
    """Batch form of count-triggered emission: (key, shard, n) in order of (ts, order)."""
    w = Window.partitionBy(key).orderBy(ts, order)
    rows = df.withColumn("shard", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy(key, "shard").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


class Shards(StatefulProcessor):
    """Rows of a key in order until ``size`` are there: then they leave as a shard; the rest waits in list state.

    With ``idle`` (milliseconds of event time) a timer lets a key's last, unfilled shard go that long after its latest row.
    """

    def __init__(self, key: str, ts: str, order: str, size: int, idle: int | None = None) -> None:
        self.key, self.ts, self.order, self.size, self.idle = key, ts, order, size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "shard long")
        self.held = handle.getListState("held", "item long, at timestamp")

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.held.get()] if self.held.exists() else []

    def _row(self, key, shard: int, rows: list[tuple]) -> tuple:
        items = [r[0] for r in rows]
        return (key, shard, len(rows), min(items), max(items))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[self.key, "shard", "n", "first", "last"])

    def handleInputRows(self, key, rows, timerValues):
        new = [r for b in rows for r in zip(b[self.order].tolist(), b[self.ts])]
        held = self._held() + sorted(new, key=lambda r: (r[1], r[0]))
        shard = self.next.get()[0] if self.next.exists() else 0
        out = []
        while len(held) >= self.size:
            out.append(self._row(key[0], shard, held[: self.size]))
            held, shard = held[self.size :], shard + 1
        self.next.update((shard,))
        self.held.clear()
        if held:
            self.held.put(held)
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if held:
                self.handle.registerTimer(int(max(r[1] for r in held).timestamp() * 1000) + self.idle)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        shard = self.next.get()[0] if self.next.exists() else 0
        self.held.clear()
        self.next.update((shard + (1 if held else 0),))
        yield self._frame([self._row(key[0], shard, held)] if held else [])

    def close(self) -> None:
        pass


def stateful_shards(stream: DataFrame, key: str, ts: str, order: str, size: int, idle: int | None = None) -> DataFrame:
    """(key, shard, n, first, last) each time a key has gathered ``size`` rows, in order of (ts, order) within a batch.

    State lies in RocksDB (``streaming_state``), so it isn't bound by the executors' memory, and outlives a restart.
    """
    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, shard long, n long, first long, last long"
    rows = stream.select(key, ts, order).groupBy(key)
    return rows.transformWithStateInPandas(Shards(key, ts, order, size, idle), out, "append", "none" if idle is None else "eventtime")


@contextlib.contextmanager
def streaming_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """RocksDB as state store for the streams that start inside, and the number of partitions of their state."""
    mine = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(partitions or 2 * spark.sparkContext.defaultParallelism),
    }
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(made: DataFrame, out: str, checkpoint: str, format: str = "parquet") -> list:
    """Runs a stream over all that has arrived and stops; the file sink's own log makes each batch count once.

    What it returns are the progress reports of its batches.
    """
    q = made.writeStream.format(format).outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return list(q.recentProgress)


def replay(rows: DataFrame, arrival: str, arrivals: int, build: Callable[[DataFrame], DataFrame], root: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The output of a stream to which ``rows`` came in the order of ``arrival`` (0, 1, ...), started anew for each of them.

    Each start goes on from the checkpoint of the one before: offsets, watermark and state are what the run before committed.
    """
    spark = rows.sparkSession
    schema = rows.drop(arrival).schema
    made = None
    for i in range(arrivals):
        rows.where(F.col(arrival) == i).drop(arrival).write.mode("append").parquet(f"{root}/in")
        made = build(read_stream(spark, f"{root}/in", schema, ts, late))
        drain(made, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(made.schema).parquet(f"{root}/out")
