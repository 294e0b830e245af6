"""Incremental state as a stream: micro-batches upsert a table, rows are told apart into new and seen, days are counted."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scratch import read_file
from ..operators.bucket_state import BucketState
from ..operators.state import pointers, read_or_empty, upsert, write_version


def stream_id(df: DataFrame, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream; it stays when the stream starts anew."""
    return json.loads(read_file(df.sparkSession, f"{checkpoint}/metadata"))["id"]


def stream_upserts(stream: DataFrame, root: str, name: str, schema: str, keys: list[str], replace: list[str], defaults: dict[str, Column], checkpoint: str) -> StreamingQuery:
    """Starts a query whose every micro-batch becomes the table's next version.

    Pointers note the stream and the batch of a version. A batch that is run
    again after a failure finds its own and is skipped; data whose pointer is
    missing are written again. Several streams may follow each other on a table.
    Old versions go. `stream_bucket_upserts` does the same without rewriting the
    whole table.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark, mine = batch.sparkSession, stream_id(batch, checkpoint)
        if pointers(spark, root, name).filter((F.col("stream") == mine) & (F.col("batch") == number)).isEmpty():
            state, version = read_or_empty(spark, root, name, schema)
            write_version(upsert(state, batch, keys, replace, defaults).drop("is_new", "in_batch"), root, name, version + 1, stream=(mine, number))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_bucket_upserts(stream: DataFrame, table: BucketState, replace: list[str], defaults: dict[str, Column], checkpoint: str) -> StreamingQuery:
    """Starts a query whose every micro-batch is one commit of a bucketed table; a batch that was committed before is skipped."""

    def one(batch: DataFrame, number: int) -> None:
        table.upsert(batch, replace, defaults, stream=(stream_id(batch, checkpoint), number))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookback_counts(stream: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts by window of time, of a table or of a stream, which leaves out rows later than its watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
