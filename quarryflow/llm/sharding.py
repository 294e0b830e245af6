"""Sharding: global byte-size prefix sums, cut at equal targets.

Documents are put in one global order, equal texts side by side. Per-partition
byte totals give every row its byte offset, and the offsets are cut at
multiples of total / shards, so shards are contiguous and near equal in bytes.
A cut that would part a group of equal texts moves to the group's nearer edge
if that shifts it by at most `tolerance` of a shard; larger groups are parted,
because sizes near equal is the law that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, store, with_positions


def byte_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.01) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts count as empty (size 1, crc32 0); null ids sort first and stay
    rows like any other; repeated rows each get a slot of their own; a very long
    text is one row, so shards differ by its size at most. An empty
    table gives an empty result. Further columns of `docs` are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_key"),
    )
    placed = store(with_positions(rows, ["text_key", "doc_id", "size", "text_crc32"], "size", "shard-order"), "shard-offsets")
    total = placed.agg(F.max(F.col("offset") + F.col("size"))).first()[0] or 0
    cuts = _cuts(placed, total, shards, tolerance)
    shard = sum((F.when(F.col("offset") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    dealt = placed.withColumn("shard", shard)
    first = {r[0]: r[1] for r in dealt.groupBy("shard").agg(F.min("row_pos")).collect()}
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_pos") - lookup(F.col("shard"), first).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(placed: DataFrame, total: int, shards: int, tolerance: float) -> list[int]:
    """The byte offsets where shards 1, 2, ... begin."""
    targets = [k * total // shards for k in range(1, shards)]
    if not total or not targets:
        return targets
    end = F.col("offset") + F.col("size")

    def holds(t: int) -> Column:
        return (F.col("offset") <= t) & (end > t)

    any_target = holds(targets[0])
    for t in targets[1:]:
        any_target |= holds(t)
    keys = [r[0] for r in placed.filter(any_target).select("text_key").collect()]
    groups = placed.filter(F.col("text_key").isin(keys)).groupBy("text_key").agg(F.min("offset"), F.max(end)).collect()
    cuts = []
    for t in targets:
        edges = [e for _, lo, hi in groups if lo <= t < hi for e in (lo, hi)]
        near = min(edges, key=lambda e: abs(e - t), default=t)
        cuts.append(near if abs(near - t) <= tolerance * total / shards else t)
    return cuts
