"""Bucketed state against upserts of plain tables: equal rows, few bytes, lost writers, streams."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarryflow.functions import scratch
from quarryflow.operators import state
from quarryflow.operators.bucket_state import BucketState, ConflictError
from quarryflow.streaming.state_stream import stream_bucket_upserts, stream_upserts

SCHEMA = "id long, key string, title string, note string, first_seen string, last_seen string, reading_status string"
BATCH = "key string, title string, seen_at string, ord long"


def defaults():
    return {"reading_status": F.lit("new"), "note": F.lit("-")}


def table(spark, path, **options):
    return BucketState(spark, str(path), SCHEMA, ("key",), **{"n_buckets": 4, **options})


def batches(spark, seed, n=3, size=25):
    r = random.Random(seed)
    return [spark.createDataFrame([(f"k{r.randrange(40)}", f"t{b}.{i}", f"2026-01-{10 + b}T{i:02d}", i) for i in range(size)], BATCH) for b in range(n)]


def rows(df, *drop):
    return sorted(map(tuple, df.drop("id", *drop).select(*[c for c in df.columns if c not in ("id", *drop)]).collect()), key=repr)


@pytest.mark.parametrize("fold", [0.0, 0.5, 1e9])
def test_equals_upserts_of_a_plain_table(spark, tmp_path, fold):
    t, plain = table(spark, tmp_path, fold=fold), spark.createDataFrame([], SCHEMA.replace("id long, ", ""))
    ids = {}
    for batch in batches(spark, 3):
        changed = t.upsert(batch, ["title"], defaults())
        whole = scratch.store(state.upsert(plain, batch, ["key"], ["title"], defaults()), "plain")
        plain = whole.drop("is_new", "in_batch")
        assert rows(changed) == rows(whole.filter("in_batch"), "in_batch")
        assert rows(t.read()) == rows(plain)
        now = {r.key: r.id for r in t.read().collect()}
        assert ids.items() <= now.items()
        assert sorted(now.values()) == list(range(1, len(now) + 1))
        ids = now
    m = t.manifest()
    assert m.version == 3 and sum(b.base_rows for b in m.buckets.values()) > 0
    assert fold == 0.5 or any(b.deltas for b in m.buckets.values()) == (fold > 0)
    assert rows(t.read(buckets={1})) == rows(t.read().filter(F.pmod(F.xxhash64("key"), F.lit(4)) == 1))


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_one_percent_of_the_keys_writes_one_percent_of_the_rows(spark, tmp_path):
    t = table(spark, tmp_path, n_buckets=8)
    t.upsert(spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("1").alias("seen_at"), F.col("id").alias("ord")), ["title"], defaults())
    whole = size(tmp_path)
    t.upsert(spark.range(500).select(F.md5(F.col("id").cast("string")).alias("key"), F.sha2(F.lit("x"), 256).alias("title"), F.lit("2").alias("seen_at"), F.col("id").alias("ord")), ["title"], defaults())
    assert size(tmp_path) - whole < 0.03 * whole
    assert t.read().filter("last_seen = '2'").count() == 500 and t.read().count() == 50_000


def test_a_batch_reads_and_writes_the_buckets_of_its_keys_alone(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batches(spark, 5)[0], ["title"], defaults())
    before = t.manifest()
    t.upsert(spark.createDataFrame([("k1", "new", "2026-02-01", 0)], BATCH), ["title"], defaults())
    changed = [b for b, x in t.manifest().buckets.items() if x != before.buckets.get(b)]
    assert len(changed) == 1
    assert t.upsert(spark.createDataFrame([], BATCH), ["title"], defaults()).count() == 0
    assert t.manifest().version == before.version + 1


def test_lost_and_rival_writers(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    first, second, third = batches(spark, 7)
    t.upsert(first, ["title"], defaults())
    want = rows(t.read())
    with monkeypatch.context() as m:  # a writer that dies before its manifest
        m.setattr("quarryflow.operators.bucket_state.put_file", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.upsert(second, ["title"], defaults())
    assert rows(t.read()) == want and t.manifest().version == 1
    stale = t.manifest()
    t.upsert(second, ["title"], defaults())
    with monkeypatch.context() as m:  # a writer that began from the version before
        m.setattr(BucketState, "manifest", lambda self: stale)
        with pytest.raises(ConflictError):
            t.upsert(third, ["title"], defaults())
    assert t.manifest().version == 2
    monkeypatch.undo()
    for _ in range(4):
        t.upsert(third, ["title"], defaults())
    assert len(scratch.listed(spark, f"{tmp_path}/manifests")) == 3
    assert rows(t.read()) == rows(t.read(t.manifest()))


def feed(spark, path, keys):
    spark.createDataFrame([(k, f"t{k}", "2026-01-01", i) for i, k in enumerate(keys)], BATCH).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(BATCH).parquet(str(path))


def test_streams_follow_each_other_on_one_table(spark, tmp_path):
    """A second stream with a checkpoint of its own is not taken for the first; a batch that comes again is."""
    t = table(spark, tmp_path / "state")
    plain = SCHEMA.replace("id long, ", "")
    for i, keys in enumerate((["a", "b"], ["c"])):
        stream = feed(spark, tmp_path / f"in{i}", keys)
        for _ in range(2):
            stream_bucket_upserts(stream, t, ["title"], defaults(), str(tmp_path / f"cp{i}")).awaitTermination(60)
            stream_upserts(stream, str(tmp_path / "v"), "papers", plain, ["key"], ["title"], defaults(), str(tmp_path / f"vcp{i}")).awaitTermination(60)
    assert sorted(r.key for r in t.read().collect()) == ["a", "b", "c"]
    assert t.manifest().version == 2 and len(t.manifest().streams) == 2
    found, version = state.read_version(spark, str(tmp_path / "v"), "papers")
    assert sorted(r.key for r in found.collect()) == ["a", "b", "c"] and version == 2
    batch = spark.createDataFrame([("z", "t", "2026", 0)], BATCH)
    done = t.manifest().streams
    assert t.upsert(batch, ["title"], defaults(), stream=next(iter(done.items()))).count() == 0
    assert t.manifest().version == 2
