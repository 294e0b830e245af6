"""Streams that remember: which keys were seen before, and which rows come too late for a window."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Seen(StatefulProcessor):
    """Per key the first and the last time, forgotten when the key has not come for `ttl` milliseconds."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "first_seen timestamp, last_seen timestamp", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first, last = zip(*[(pdf["first_at"].min(), pdf["last_at"].max()) for pdf in rows], strict=True)
        before = self.times.get() if self.times.exists() else None
        now: tuple[datetime, datetime] = (before[0] if before else min(first).to_pydatetime(), max(last).to_pydatetime())
        self.times.update(now)
        yield pd.DataFrame({"k": [str(key[0])], "first_seen": [pd.Timestamp(now[0])], "last_seen": [pd.Timestamp(now[1])], "is_new": [before is None]})

    def close(self) -> None:
        pass


def seen_stream(rows: DataFrame, key: str, time: str, ttl: int | None = None) -> DataFrame:
    """k (the key as text), first_seen, last_seen, is_new of each key of each micro-batch.

    A key keeps the time of its first row, as `state.upsert` does; last_seen
    follows the batch. What is remembered lies in a RocksDB store on the
    executors' disks and in the checkpoint, one entry a key, and goes once a key
    has not come for `ttl` milliseconds (never, if not given). Rows of one key
    are folded before they are shuffled, so a hot key sends a row from each
    Arrow batch.
    """

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.groupby("k", as_index=False).agg(first_at=("at", "min"), last_at=("at", "max"))

    some = rows.select(F.col(key).cast("string").alias("k"), F.col(time).alias("at")).filter("k IS NOT NULL AND at IS NOT NULL")
    partial = some.mapInPandas(folded, "k string, first_at timestamp, last_at timestamp")
    schema = "k string, first_seen timestamp, last_seen timestamp, is_new boolean"
    return partial.groupBy("k").transformWithStateInPandas(_Seen(ttl), schema, "Append", "ProcessingTime" if ttl else "None")


def start_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream gives to a Parquet table, all that is there now; its state is kept by RocksDB."""
    conf = df.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)


def lookback_stream(rows: DataFrame, id: str, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts of a stream by window, each window once it is complete; rows later than the watermark are left out.

    Rows of one id count once. `late_rows` of the query tells how many were left
    out: the first operator, which knows single rows, is the one that drops them.
    """
    once = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([id])
    return once.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def late_rows(query: StreamingQuery) -> int:
    """The rows that a query's stateful operators left out because they came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
