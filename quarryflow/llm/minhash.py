"""MinHash near-dedup by an inverted join of signature coordinates.

A document is the set of its distinct word shingles; equal sets collapse first.
A signature has the least of the set's hashes under each of 64 functions. Two sets
that are similar enough agree in `threshold` coordinates or more but for a chance
of 1e-8, so the join is one of overlap: documents are posted under their
coordinate-value pairs, in the global order of how many documents have the pair,
and only under a prefix of them. Of 64 pairs the 64 - threshold + 1 rarest suffice:
who agrees in `threshold` pairs shares one of those. Pairs that one document alone
has are in the prefix first and need no posting. A task merges one list: it counts
collisions of signatures, skips who cannot reach the threshold with the coordinates
left and who is linked already, and emits a forest. Full sets then decide: first
each document against the centre it met, then, between groups that still may be
similar, all documents in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_texts, release_shuffles, row_key, small, store
from .components import connected_components
from .near_dedup import CHUNK, CHUNK_SHINGLES, _across, _compared, ascii_lower
from .rolling import WORD_BASE, Words, in_portions, mix, stretch_hashes

COORDINATES = 64
#: Coordinates in which a pair must agree. At a similarity of 0.85 fewer agree in 6 of 10^9 pairs.
THRESHOLD = 36
#: Coordinates that are compared before pairs are skipped.
FIRST = 40
#: Documents of a list that meet in one task; longer lists are split into chunks of half.
MEET = 4096
_SALTS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _FACTOR = _SALTS[:COORDINATES, None], _SALTS[COORDINATES:, None] | np.uint64(1)


def shingle_rows(words: Words, shingle: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, repeats included; fewer words are one shingle, none have none."""
    hashes, _ = words.windows(shingle)
    for first, end in zip(words.doc_from[:-1].tolist(), words.doc_from[1:].tolist(), strict=True):
        n = end - first
        if 0 < n < shingle:
            yield stretch_hashes(words.hash[first:end], np.array([0]), np.array([n]), WORD_BASE)
        else:
            yield hashes[first : end - shingle + 1] if n else hashes[:0]


def shingle_sets(texts: list[str], shingle: int = 3) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingles."""
    for lo, hi in in_portions(texts):
        for h in shingle_rows(Words(texts[lo:hi], ascii_lower), shingle):
            yield np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the least hashes under each function."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[None, at : at + 2048] ^ _XOR) * _FACTOR).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(texts: list[str], shingle: int = 3) -> dict[str, list]:
    """n (set size), tag (16 bytes that identify the set), sig (a value for each coordinate) and low (a byte of each) of each text."""
    out: dict[str, list] = {"n": [], "tag": [], "sig": [], "low": []}
    for s in shingle_sets(texts, shingle):
        sig = signature(s)
        out["n"].append(len(s))
        out["tag"].append(hashlib.md5(s.tobytes(), usedforsecurity=False).digest())
        out["sig"].append(sig.tobytes())
        out["low"].append(sig.astype(np.uint8).tobytes())
    return out


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    places = np.arange(COORDINATES, dtype=np.int64) << 32
    for pdf in batches:
        values = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, COORDINATES).astype(np.int64) + places
        yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), COORDINATES), "elem": values.ravel()})


def postings(unique: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """node, elems: the coordinate-value pairs of its prefix that another has too, of each node that has any. unique: node, sig."""
    elements = unique.select("node", "sig").mapInPandas(_elements, "node long, elem long")
    shared = store(elements.groupBy("elem").agg(F.count("*").alias("df")).filter("df > 1"), "minhash-shared")
    held = elements.join(small(shared), "elem").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "elem"))).alias("e"))  # 64 at most
    # those that it has alone come before in the order, so the prefix ends threshold - 1 before the last
    prefix = held.filter(F.size("e") >= threshold).select("node", F.expr(f"transform(slice(e, 1, size(e) - {threshold - 1}), x -> x.elem)").alias("elems"))
    return prefix


def collisions(nodes: np.ndarray, labels: np.ndarray, low: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Pairs of nodes that agree in `threshold` coordinates and join all labels which such pairs join."""
    label = np.unique(labels, return_inverse=True)[1]
    out = []
    for i in range(len(nodes) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(j):
            continue
        j = j[(low[j, :FIRST] == low[i, :FIRST]).sum(1) >= threshold - (COORDINATES - FIRST)]
        j = j[(low[j] == low[i]).sum(1) >= threshold]
        if len(j):
            met, first = np.unique(label[j], return_index=True)
            out += [(int(nodes[i]), int(n)) for n in nodes[j[first]]]
            label[np.isin(label, met)] = label[i]
    return out


def _merger(threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of their list, and a list is merged whole."""
        held: list[tuple] = []
        part = None

        def links() -> list[tuple[int, int]]:
            nodes, labels, low = (np.concatenate([h[i] for h in held]) for i in range(3))
            return collisions(nodes, labels, low, threshold) if len(nodes) > 1 else []

        for pdf in batches:
            parts, nodes, labels = (pdf[c].to_numpy() for c in ("part", "node", "label"))
            low = np.frombuffer(b"".join(pdf["low"]), np.uint8).reshape(-1, COORDINATES)
            cuts = (np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist()
            found = []
            for s, e in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if held and parts[s] != part:
                    found += links()
                    held = []
                part = parts[s]
                held.append((nodes[s:e], labels[s:e], low[s:e]))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        if held:
            yield pd.DataFrame(links(), columns=["a", "b"], dtype=np.int64)

    return run


def merged_lists(posted: DataFrame, threshold: int, name: str) -> DataFrame:
    """Links a, b that join all labels which collisions join, stored. posted: node, label, low, elems."""
    rows = posted.select("node", "label", "low", F.explode("elems").alias("elem"))
    often = store(rows.groupBy("elem").count().filter(F.col("count") > MEET), f"{name}-often")
    lists = rows.select("node", "label", "low", F.col("elem").alias("part"))
    if not often.isEmpty():
        chunks = F.ceil(F.col("count") / (MEET // 2)).cast("int")
        split = rows.join(often, "elem").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        part = F.xxhash64("elem", F.least("own", "other"), F.greatest("own", "other"))
        lists = rows.join(often, "elem", "left_anti").select("node", "label", "low", F.col("elem").alias("part")).unionByName(split.select("node", "label", "low", part.alias("part")))
    dealt = lists.repartition("part").sortWithinPartitions("part", "node")
    return store(dealt.mapInPandas(_merger(threshold), "a long, b long").distinct(), name)


def _stars(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that full sets confirm, of each centre with those that met it; a hot centre's are dealt to chunks that all have it."""
    leaves = links.join(sets.select(F.col("node").alias("b"), "n"), "b")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    sizes = store(links.join(sets.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(chunks.alias("chunks")), "minhash-centres")
    part = F.xxhash64("a", "chunk")
    dealt = leaves.join(sizes, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    members = dealt.select(part.alias("part"), F.col("b").alias("node"))
    centres = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(part.alias("part"), F.col("a").alias("node"))
    named = members.unionByName(centres).join(sets.select("node", "s"), "node")
    return _compared(named.withColumn("label", F.col("node")), similarity, "minhash-links")


def minhash_groups(docs: DataFrame, similarity: float = 0.85, shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept of every row.

    Rows are linked if 100 times the shingles that both sets have are 85 times
    those of either or more. Texts without words (null ones too) have no shingles
    and no links; fewer words than a shingle are one; very long texts are hashed
    whole, in portions. Repeated rows and ties share a component. Null ids never
    name a component: one of null ids only has a null component_id, and a row is
    kept if its id is its component's, null or not. An empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("key"))
    rows = store(map_texts(texts, ["doc_id", "key"], ["text"], lambda t: signed(t, shingle), {"n": "long", "tag": "binary", "sig": "binary", "low": "binary"}), "minhash-rows")
    grouped = rows.filter("n > 0").groupBy("tag").agg(F.count("*").alias("times"), F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low"))
    unique = store(grouped.withColumn("node", F.monotonically_increasing_id()), "minhash-unique")

    posted = store(postings(unique, threshold).join(unique.select("node", "low"), "node"), "minhash-posted")
    release_shuffles(spark)
    met = merged_lists(posted.withColumn("label", F.col("node")), threshold, "minhash-met")
    wanted = store(met.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(unique.select("node", "key", "n"), "node"), "minhash-wanted")
    named = texts.select("key", "text").join(small(wanted), "key").dropDuplicates(["node"])
    sets = store(map_texts(named, ["node", "n"], ["text"], lambda t: {"s": [x.tobytes() for x in shingle_sets(t, shingle)]}, {"s": "binary"}), "minhash-sets")
    release_shuffles(spark)
    roots = connected_components(_stars(met, sets, similarity))

    # collisions between groups that the centres left apart
    labelled = posted.join(small(roots.select("node", F.col("root"))), "node", "left").withColumn("label", F.coalesce("root", "node"))
    again = merged_lists(labelled.select("node", "label", "low", "elems"), threshold, "minhash-again")
    if not again.isEmpty():
        label = roots.select("node", F.col("root").alias("label"))
        ends = again
        for c in ("a", "b"):
            ends = ends.join(label.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("label", c)).drop("label")
        near = connected_components(ends)
        groups = near.select(F.col("node").alias("label"), F.col("root").alias("grp")).unionByName(near.select(F.col("root").alias("label"), F.col("root").alias("grp")).distinct())
        inside = sets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).join(small(groups), "label").select("grp", "node", "label", "s")
        more = _compared(_across(store(inside, "minhash-inside")), similarity, "minhash-links")
        roots = connected_components(more.unionByName(roots.toDF("a", "b")))
    release_shuffles(spark)
    drop_stored(sets)

    linked = store(unique.select("node", "tag", "least").join(roots, "node"), "minhash-linked")
    tops = unique.select(F.col("node").alias("root"), "tag", "least").join(linked.select("root").distinct(), "root")
    joined = store(linked.select("root", "tag", "least").unionByName(tops.select("root", "tag", "least")), "minhash-joined")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = unique.filter("times > 1").join(joined.select("tag"), "tag", "left_anti").select("tag", F.col("least").alias("component_id"))
    shown = store(joined.join(least, "root").select("tag", "component_id").unionByName(alone), "minhash-named")
    # texts that no other row has or is linked to are their own component
    out = rows.select("doc_id", "n", "tag").join(small(shown.withColumn("named", F.lit(True))), "tag", "left")
    out = out.withColumn("component_id", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
