"""Benchmark decontamination with DataFrame functions alone.

Texts are lower-cased and cut into words; a shingle is five words in a row, or
all words of a shorter text. A window of a document has the size of a benchmark
item. The similarity of window and item is the weighted Jaccard of their shingle
multisets, sum(min) / sum(max); a document is contaminated if some window
reaches the threshold for some item.

1. An inverted index of the items' shingles finds the places where documents
   have one; windows without any have similarity 0. A window that reaches the
   threshold shares so much of an item of n shingles that it cannot lack all of
   the n - ceil(threshold * n) + 1 that documents have least often, so those
   alone tell which documents and items meet.
2. Moving a window right over a shingle that the item lacks never lowers the
   similarity, so the best window starts at a shared shingle or is the last one
   of the document; of these, windows with too few shared shingles to reach the
   threshold go.
3. The windows left get a SimHash fingerprint. Fingerprints are cut into
   radius + 1 blocks; a window and its item within the radius agree in a block,
   so the join on item and block misses none.
4. Each pair within the radius is verified by its exact similarity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, row_key, small, store

SHINGLE = 5


def shingled(df: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """keep, n_words and shingles (hashes of five words each, or of all words if they are fewer; none without words).

    No lambda refers to another array, and nothing filters on the arrays: the
    optimizer would copy what they are made from into the lambda or the filter
    and work it out again for each word.
    """
    word = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    hashed = df.select(*keep, F.transform(word, lambda w: F.xxhash64(w)).alias("w"))
    names = [c for c in hashed.columns if c != "w"]
    n = F.when(F.size("w") > 0, F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))).otherwise(0)
    side_by_side = F.arrays_zip(*[F.slice("w", j + 1, n).alias(f"w{j}") for j in range(SHINGLE)])
    # places beyond a short text are null and hash like nothing
    five = F.transform(side_by_side, lambda z: F.xxhash64(*[z[f"w{j}"] for j in range(SHINGLE)]))
    return hashed.select(*names, F.size("w").alias("n_words"), five.alias("shingles"))


def simhash(rows: DataFrame, by: list[str], shingle: str, weight: str, lanes: int = 4) -> DataFrame:
    """by, fp: bit b is 1 if shingles with that bit weigh more than half.

    With four lanes sixteen sums hold four bits each, in lanes of 16 bits: bit
    16 * lane + k lies in sum k, and weights must add up to less than 2^15. Two
    lanes of 32 bits take 32 sums, for weights of less than 2^31.
    """
    width = 64 // lanes
    ones = F.lit(sum(1 << width * lane for lane in range(lanes)))
    sums = [F.sum(F.shiftrightunsigned(shingle, k).bitwiseAND(ones) * F.col(weight)).alias(f"s{k}") for k in range(width)]
    added = rows.groupBy(*by).agg(F.sum(weight).alias("all"), *sums)
    fp = F.lit(0).cast("long")
    for k in range(width):
        for lane in range(lanes):
            count = F.shiftrightunsigned(f"s{k}", width * lane).bitwiseAND(F.lit((1 << width) - 1))
            bit = 1 << (width * lane + k)
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("all"), F.lit(bit - 2**64 if bit >= 2**63 else bit)).otherwise(F.lit(0).cast("long")))
    return added.select(*by, fp.alias("fp"))


def block_keys(radius: int) -> Column:
    """The radius + 1 blocks of fp, each with its number."""
    cut = [64 * i // (radius + 1) for i in range(radius + 2)]
    each = []
    for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
        each.append(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * (radius + 1) + i)
    return F.explode(F.array(*each))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 24) -> DataFrame:
    """row (the key of id and text), doc_id, item_id, start, n_words, hamming, similarity: the best window for each document and item.

    Ties go to the earliest window of those in step 2. Texts without words match
    nothing. A text of fewer than five words is one shingle, so such an item
    matches documents of the same words alone. A document shorter than an item
    is one window. Texts and items of any length are taken whole. Equal rows
    share a result; items of one id count each. The radius is wide for the
    threshold: windows at 0.8 differ from their item in about 10 of 64 bits.
    """
    every_item = store(shingled(benchmark, [F.monotonically_increasing_id().alias("item"), F.col("item_id")]), "leaks-items").filter(F.size("shingles") > 0)
    exploded = every_item.select("item", "item_id", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    index = store(exploded.groupBy("item", "item_id", "n", "h").agg(F.count("*").alias("weight")), "leaks-index")
    n_index, longest = index.agg(F.count("*"), F.max("n")).first()
    lanes = 4 if (longest or 0) < 2**15 else 2

    # where documents have a shingle of any item
    shingles = shingled(docs, [row_key().alias("row"), F.col("doc_id")]).select("row", "doc_id", "n_words", F.size("shingles").alias("size"), F.posexplode_outer("shingles").alias("pos", "h"))
    # rows that are all alike count once, and are made one in each task
    hits = store(shingles.join(small(index.select("h").distinct(), n_index), "h", "left_semi").distinct(), "leaks-hits")
    often = hits.groupBy("h").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("item").orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1)
    rare = index.join(small(often, n_index), "h").withColumn("before", F.coalesce(F.sum("weight").over(rarest), F.lit(0)))
    absent = index.join(small(often, n_index), "h", "left_anti").groupBy("item").agg(F.sum("weight").alias("absent"))
    rare = rare.join(small(absent, n_index), "item", "left").filter(F.col("before") + F.coalesce("absent", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9))
    rare = store(rare.select("item", "h"), "leaks-rare")
    met = store(hits.select("row", "h").join(small(rare, n_index), "h").select("row", "item").distinct(), "leaks-met")

    by_pair = hits.join(met, "row").join(small(index.select("item", "n", "h"), n_index), ["item", "h"])
    by_pair = by_pair.groupBy("row", "doc_id", "n_words", "size", "item", "n").agg(F.sort_array(F.collect_set("pos")).alias("hits"))
    last = F.greatest(F.col("size") - F.col("n"), F.lit(0))
    full = F.least("n", "size")  # shingles of the last window
    enough = F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9).cast("int")
    enough_last = F.ceil((F.col("n") + full) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    by_pair = by_pair.withColumns({"last": last, "full": full, "enough": enough, "enough_last": enough_last})
    starts = F.filter("hits", lambda p, r: (p <= F.col("last")) & (F.get(F.col("hits"), r + F.col("enough") - 1) < p + F.col("n")))
    at_end = F.when(F.size(F.filter("hits", lambda p: p >= F.col("last"))) >= F.col("enough_last"), F.array(F.col("last"))).otherwise(F.array().cast("array<int>"))
    windows = store(by_pair.select("row", "doc_id", "n_words", "item", "n", F.explode(F.array_distinct(F.array_union(starts, at_end))).alias("start")), "leaks-windows")

    # the shingles of those windows, from their documents
    named = store(windows.select("row").distinct(), "leaks-docs")
    texts = docs.select(row_key().alias("row"), "text").join(small(named), "row", "left_semi").dropDuplicates(["row"])
    texts = shingled(texts, [F.col("row")]).select("row", "shingles")
    window = ["row", "start", "n"]
    placed = windows.select(*window).distinct().join(texts, "row").select(*window, F.explode_outer(F.slice("shingles", F.col("start") + 1, F.col("n"))).alias("h"))
    counted = store(placed.groupBy(*window, "h").agg(F.count("*").alias("weight")), "leaks-shingles")

    fps = simhash(counted, window, "h", "weight", lanes)
    item_fps = simhash(index, ["item"], "h", "weight", lanes)
    item_blocks = item_fps.select("item", F.col("fp").alias("item_fp"), block_keys(radius).alias("block"))
    near = windows.join(fps, window).select("item", *window, "doc_id", "n_words", "fp", block_keys(radius).alias("block"))
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = near.join(small(item_blocks, n_index * (radius + 1)), ["item", "block"]).select("item", *window, "doc_id", "n_words", hamming.alias("hamming")).filter(F.col("hamming") <= radius).distinct()
    common = near.join(counted, window).join(small(index.select("item", "item_id", "h", F.col("weight").alias("item_weight")), n_index), ["item", "h"])
    common = common.groupBy(*window, "item", "item_id", "doc_id", "n_words", "hamming").agg(F.sum(F.least("weight", "item_weight")).alias("both"))
    sizes = counted.groupBy(*window).agg(F.sum("weight").alias("m"))
    scored = common.join(sizes, window).withColumn("similarity", F.col("both") / (F.col("m") + F.col("n") - F.col("both")))
    n_words = F.least(F.col("m") + (SHINGLE - 1), F.col("n_words")).cast("int").alias("n_words")
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "start", n_words, "hamming")).alias("b")
    best = scored.filter(F.col("similarity") >= threshold).groupBy("row", "doc_id", "item_id").agg(best)
    return best.select("row", "doc_id", "item_id", "b.start", "b.n_words", "b.hamming", (-F.col("b.less")).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 24) -> DataFrame:
    """doc_id, item_id, start, n_words, hamming, similarity, as `leaks` has them; start counts words from 0.

    Null ids are kept. An empty table on either side gives an empty result;
    further columns are ignored.
    """
    found = leaks(docs, benchmark, threshold, radius)
    return found.select("doc_id", "item_id", "start", "n_words", "hamming", F.round("similarity", 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 24) -> DataFrame:
    """The documents without a leak, all columns kept. Texts without words stay."""
    key = fresh(docs, "row")
    bad = store(leaks(docs, benchmark, threshold, radius).select(F.col("row").alias(key)).distinct(), "leaks-found")
    return docs.withColumn(key, row_key()).join(small(bad), key, "left_anti").select(*docs.columns)
