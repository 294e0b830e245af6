"""Packing: length buckets that minimise padding, and token-budget batches inside them.

Documents longer than `max_tokens` are cut into pieces of at most that length,
so the global histogram of piece lengths has at most `max_tokens` entries. A
dynamic program over it picks the bucket boundaries with the least padding;
inside each bucket pieces form batches whose padded size fits the budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lookup, store, with_positions, words


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Boundaries (bucket lengths) with the least padding over a histogram of lengths.

    cost[j] after b rounds is the least padding of the j shortest lengths in b
    buckets, each padded to its longest. Ties go to the earlier cut. Lengths of
    zero or less need no bucket.
    """
    lengths = np.array(sorted(n for n in histogram if n > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    m = len(lengths)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    steps = []
    for _ in range(min(buckets, m)):
        new, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            padded = cost[:j] + (rows[j] - rows[:j]) * lengths[j - 1] - (tokens[j] - tokens[:j])
            back[j] = int(np.argmin(padded))
            new[j] = padded[back[j]]
        cost = new
        steps.append(back)
    bounds, j = [], m
    for back in reversed(steps):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(back[j])
    return sorted(bounds)


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD))


def pack(docs: DataFrame, max_tokens: int = 2048, buckets: int = 8, budget: int = 32768, length: Column | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start_token, n_tokens, bucket_len, batch, slot, padding.

    `length` counts a document's tokens (its words, if not given). A batch of
    bucket length b holds budget // b pieces (at least one); batches are
    numbered without gaps. A document without tokens (null or empty text) is one
    row with n_tokens 0 and null bucket, batch and slot. A very long one is as many
    pieces as it takes. Repeated rows and null ids are packed like any others; an
    empty table gives an empty result; further columns are ignored.
    """
    counted = docs.select("doc_id", (word_count() if length is None else length).cast("long").alias("doc_tokens"))
    last = F.greatest(F.ceil(F.col("doc_tokens") / max_tokens) - 1, F.lit(0)).cast("int")
    pieces = counted.select("doc_id", "doc_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * max_tokens).alias("start_token"),
        F.least(F.col("doc_tokens") - F.col("piece").cast("long") * max_tokens, F.lit(max_tokens)).alias("n_tokens"),
    )
    pieces = store(pieces, "pack-pieces")
    histogram = dict(pieces.groupBy("n_tokens").count().collect())  # at most max_tokens + 1 rows
    bounds = best_boundaries(histogram, buckets)
    bucket = F.lit(None).cast("int")
    for b in reversed(bounds):
        bucket = F.when((F.col("n_tokens") <= b) & (F.col("n_tokens") > 0), F.lit(b)).otherwise(bucket)
    placed = with_positions(pieces.withColumn("bucket_len", bucket), ["bucket_len", "doc_id", "piece", "n_tokens"], name="pack-order")
    first, base, before, batches = {}, {}, histogram.get(0, 0), 0  # rows without a bucket sort first
    low = 0
    for b in bounds:
        n = sum(c for k, c in histogram.items() if low < k <= b)
        first[b], base[b] = before, batches
        before, batches, low = before + n, batches + -(-n // max(1, budget // b)), b
    rank = F.col("row_pos") - lookup(F.col("bucket_len"), first).cast("long")
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    return placed.select(
        "doc_id",
        "piece",
        "start_token",
        "n_tokens",
        "bucket_len",
        (lookup(F.col("bucket_len"), base).cast("long") + F.floor(rank / room)).alias("batch"),
        (rank % room).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).cast("long").alias("padding"),
    )


def piece_texts(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed pieces with their words, joined by one space, for a writer of training files."""
    cut = F.slice(words("text"), F.col("start_token").cast("int") + 1, F.col("n_tokens").cast("int"))
    return packed.join(docs.select("doc_id", "text"), "doc_id").withColumn("piece_text", F.array_join(cut, " ")).drop("text")
