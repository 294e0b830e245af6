"""Streams with memory: new and seen keys over restarts, forgetting, late rows."""

import time

from pyspark.sql import functions as F

from quarryflow.streaming.seen_stream import late_rows, lookback_stream, seen_stream, start_append

SCHEMA = "id long, key string, at timestamp"


def feed(spark, path, rows):
    df = spark.createDataFrame(rows, "id long, key string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{path}/in")


def run(df, path):
    query = start_append(df, f"{path}/out", f"{path}/cp")
    query.awaitTermination(120)
    return query


def test_keys_are_new_once_over_restarts(spark, tmp_path):
    path = str(tmp_path)
    stream = feed(spark, path, [(1, "a", "2026-01-01 10:00:00"), (2, "a", "2026-01-01 09:00:00"), (3, "b", "2026-01-02 00:00:00"), (4, None, "2026-01-02 00:00:00"), (5, "c", None)])
    run(seen_stream(stream, "key", "at"), path)
    feed(spark, path, [(6, "a", "2026-02-01 00:00:00"), (7, "d", "2026-01-05 00:00:00"), (8, "a", "2026-01-20 00:00:00")])
    run(seen_stream(stream, "key", "at"), path)
    run(seen_stream(stream, "key", "at"), path)
    got = sorted((r.k, str(r.first_seen), str(r.last_seen), r.is_new) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [
        ("a", "2026-01-01 09:00:00", "2026-01-01 10:00:00", True), ("a", "2026-01-01 09:00:00", "2026-02-01 00:00:00", False),
        ("b", "2026-01-02 00:00:00", "2026-01-02 00:00:00", True), ("d", "2026-01-05 00:00:00", "2026-01-05 00:00:00", True),
    ]


def test_what_has_not_come_for_its_time_is_forgotten(spark, tmp_path):
    path = str(tmp_path)
    stream = feed(spark, path, [(1, "a", "2026-01-01 00:00:00")])
    run(seen_stream(stream, "key", "at", ttl=1000), path)
    time.sleep(1.5)
    feed(spark, path, [(2, "a", "2026-01-02 00:00:00")])
    query = run(seen_stream(stream, "key", "at", ttl=1000), path)
    assert [r.is_new for r in spark.read.parquet(f"{path}/out").collect()] == [True, True]
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    path = str(tmp_path)
    stream = feed(spark, path, [(1, "a", "2026-01-01 01:00:00"), (2, "a", "2026-01-01 02:00:00"), (2, "a", "2026-01-01 02:00:00"), (3, "b", "2026-01-03 12:00:00")])
    counts = lambda: lookback_stream(stream, "id", "at", "1 day", "1 day", "key")
    assert late_rows(run(counts(), path)) == 0
    feed(spark, path, [(4, "a", "2026-01-01 05:00:00"), (5, "a", "2026-01-02 05:00:00"), (6, "b", "2026-01-02 13:00:00"), (7, "c", "2026-01-05 00:00:00")])
    assert late_rows(run(counts(), path)) == 2
    got = sorted((str(r.window.start)[:10], r.key, r.n) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [("2026-01-01", "a", 2), ("2026-01-02", "b", 1), ("2026-01-03", "b", 1)]
