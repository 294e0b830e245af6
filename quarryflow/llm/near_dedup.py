"""Near-dedup of texts: wide SimHash fingerprints propose groups, exact shingle counts decide.

Similarity is the Jaccard of multisets of five-word shingles. Equal texts
collapse first. 256-bit fingerprints that meet under a key and differ in few
bits join their texts to candidate groups (bit-sliced, as in `simhash`); inside
a group the shingle sets themselves are compared. A group comes in chunks of
bounded size: first each chunk for itself, dealt in two ways if there are several, which settles all
but the largest groups and melts copies into few labels there; then every two
chunks that hold different labels. So each pair of a group is compared unless
its texts are linked already, and no task holds more than two chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_texts, release_shuffles, row_key, small, store, text_key
from .components import connected_components
from .rolling import WORD_BASE, Words, in_portions, mix, stretch_hashes
from .simhash import bit_counts, meet

#: 64-bit words of a fingerprint.
WIDE = 4
#: Texts, and shingles, of a chunk on average at most.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
_SALTS = np.array([0x9E3779B97F4A7C15 * (i + 1) % 2**64 for i in range(WIDE)], np.uint64)


def ascii_lower(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + 32, points)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a sorted set: the first of equal ones stays, the next get a hash of their number too."""
    h = np.sort(hashes)
    places = np.arange(len(h))
    new = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
    n = (places - np.maximum.accumulate(np.where(new, places, 0))).astype(np.uint64)
    return np.sort(np.where(n > 0, mix(h ^ mix(n)), h))


def shingle_sets(texts: list[str], shingle: int = 5) -> Iterator[np.ndarray]:
    """The numbered word shingles of each text; a shorter text is one, a text without words has none."""
    for lo, hi in in_portions(texts):
        words = Words(texts[lo:hi], ascii_lower)
        hashes, _ = words.windows(shingle)
        for d in range(hi - lo):
            first, end = words.doc_from[d], words.doc_from[d + 1]
            n = end - first
            if 0 < n < shingle:
                yield stretch_hashes(words.hash[first:end], np.array([0]), np.array([n]), WORD_BASE)
            else:
                yield numbered(hashes[first : end - shingle + 1] if n else hashes[:0])


def wide_fingerprints(texts: list[str], shingle: int = 5) -> list[bytes]:
    """256 bits of each text by majority over its numbered shingles; four hashes of a shingle give 64 bits each."""
    out = []
    for h in shingle_sets(texts, shingle):
        counts = np.zeros(64 * WIDE, np.int64)
        for at in range(0, len(h), 4080):
            counts += bit_counts(mix(h[at : at + 4080, None] + _SALTS[None, :]))
        out.append(np.packbits(2 * counts > len(h), bitorder="little").tobytes())
    return out


def proposals(rows: DataFrame, similarity: float = 0.8, miss: float = 0.0005) -> DataFrame:
    """Links a, b between 256-bit fingerprints (columns node, bits) that may be similar: a forest of each set that meets.

    Texts of Jaccard s have a cosine of 2 s / (1 + s) at least, and a bit
    differs with probability acos(cosine) / pi. The radius is that share of the
    bits and four standard deviations; of the first 80 bits, five. Keys are
    random choices of bits, as many as let a pair at the threshold miss all of
    them with probability `miss`; their length follows the number of rows, so
    that about 512 rows, a block of the comparison, meet by chance.
    """
    bits = 64 * WIDE
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.floor(bits * differs + 4 * math.sqrt(bits * differs * (1 - differs)))
    limit = math.floor(80 * differs + 5 * math.sqrt(80 * differs * (1 - differs)))
    length = max(6, math.ceil(math.log2(max(2, rows.count()) / 512)))
    n_keys = math.ceil(math.log(miss) / math.log(1 - (1 - differs) ** length))
    rng = np.random.default_rng(17)
    places = np.array([rng.choice(bits, length, replace=False) for _ in range(n_keys)])
    weights = (1 << np.arange(length)).astype(np.int64)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = np.unpackbits(np.frombuffer(b"".join(pdf["bits"]), np.uint8).reshape(len(pdf), -1), axis=1, bitorder="little")
            values = got[:, places].astype(np.int64) @ weights * n_keys + np.arange(n_keys)
            yield pd.DataFrame({**{c: np.repeat(pdf[c].to_numpy(), n_keys) for c in ("node", "bits")}, "key": values.ravel()})

    keyed = rows.select("node", "bits").mapInPandas(keys, "node long, bits binary, key long")
    return meet(keyed, radius, "similar", (80, limit))


def common_counts(mark: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marked ids each stretch of ids holds."""
    n = ends - starts
    upto = np.cumsum(n)
    at = np.repeat(starts - (upto - n), n) + np.arange(upto[-1])
    marked = np.concatenate(([0], np.cumsum(mark[ids[at]])))
    return marked[upto] - marked[upto - n]


def similar_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes with similar sets that join all labels which such pairs join: a forest over the labels."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(ids.max(initial=-1) + 1, bool)
    label = np.unique(labels, return_inverse=True)[1]
    out = []
    for i in range(len(nodes) - 1):
        rest = sizes[i + 1 :]
        might = (label[i + 1 :] != label[i]) & (np.minimum(rest, sizes[i]) >= similarity * np.maximum(rest, sizes[i]) - 1e-9)
        j = np.flatnonzero(might) + i + 1
        if not len(j):
            continue
        own = ids[starts[i] : ends[i]]
        mark[own] = True
        both = common_counts(mark, ids, starts[j], ends[j])
        mark[own] = False
        for k in j[both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9]:
            if label[k] != label[i]:
                out.append((nodes[i], nodes[k]))
                label[label == label[k]] = label[i]
    return out


def _linker(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of their part, and a part is compared whole."""
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        part = None

        def links() -> pd.DataFrame:
            nodes, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            sets = [np.frombuffer(s, np.uint64) for h in held for s in h[2]]
            found = similar_links(nodes, labels, sets, similarity) if len(nodes) > 1 else []
            return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

        for pdf in batches:
            parts, nodes, labels, sets = pdf["part"].to_numpy(), pdf["node"].to_numpy(), pdf["label"].to_numpy(), pdf["s"].tolist()
            cuts = (np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist()
            found = []
            for s, e in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if held and parts[s] != part:
                    found.append(links())
                    held = []
                part = parts[s]
                held.append((nodes[s:e], labels[s:e], sets[s:e]))
            if found:
                yield pd.concat(found)
        if held:
            yield links()

    return run


def _compared(dealt: DataFrame, similarity: float, name: str) -> DataFrame:
    """Links a, b inside the parts of dealt (part, node, label, s), stored."""
    rows = dealt.select("part", "node", "label", "s").repartition("part").sortWithinPartitions("part")
    return store(rows.mapInPandas(_linker(similarity), "a long, b long"), name)


def _chunks(texts: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(texts) / CHUNK), F.ceil(F.col(shingles) / CHUNK_SHINGLES), F.lit(1)).cast("int")


def _measured(sets: DataFrame, *by: str) -> DataFrame:
    """by, texts, shingles, chunks."""
    sizes = sets.groupBy(*by).agg(F.count("*").alias("texts"), F.sum(F.floor(F.octet_length("s") / 8)).alias("shingles"))
    return sizes.withColumn("chunks", _chunks("texts", "shingles"))


def _across(sets: DataFrame) -> DataFrame:
    """part, node, label, s: for every two chunks of a group that hold different labels both of them.

    A label of half a chunk and more has chunks of its own, which need not meet;
    smaller labels of a group share chunks (team -1).
    """
    sizes = store(_measured(sets, "grp", "label"), "similar-labels")
    many = (F.col("texts") * 2 >= CHUNK) | (F.col("shingles") * 2 >= CHUNK_SHINGLES)
    large = sizes.filter(many).select("grp", F.col("label").alias("team"), "chunks")
    pooled = sizes.filter(~many).groupBy("grp").agg(F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles"))
    teams = store(large.unionByName(pooled.select("grp", F.lit(-1).cast("long").alias("team"), _chunks("texts", "shingles").alias("chunks"))), "similar-teams")
    left, right = (teams.select("grp", F.col("team").alias(f"t{x}"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias(f"c{x}")) for x in "ab")
    two = left.join(right, "grp").filter("ta < tb OR ta = -1 AND tb = -1 AND ca <= cb")
    two = store(two.withColumn("part", F.xxhash64("grp", "ta", "ca", "tb", "cb")), "similar-pairs")
    ends = two.select("part", "grp", F.col("ta").alias("team"), F.col("ca").alias("chunk"))
    ends = ends.unionByName(two.filter("ta <> tb OR ca <> cb").select("part", "grp", F.col("tb").alias("team"), F.col("cb").alias("chunk")))
    team = sets.join(sizes.withColumn("team", F.when(many, F.col("label")).otherwise(F.lit(-1))).select("grp", "label", "team"), ["grp", "label"]).join(teams, ["grp", "team"])
    by = F.when(F.col("team") == -1, F.col("label")).otherwise(F.col("node"))
    placed = team.select("grp", "team", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int").alias("chunk"), "node", "label", "s")
    return placed.join(ends, ["grp", "team", "chunk"]).select("part", "node", "label", "s")


def similar_rows(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, key, tag, root of every row: key and tag identify row and text, root the group of similar texts."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("key"), text_key().alias("tag"))
    rows = store(map_texts(texts, ["doc_id", "key", "tag"], ["text"], lambda t: {"bits": wide_fingerprints(t, shingle)}, {"bits": "binary"}), "similar-rows")
    unique = rows.groupBy("tag").agg(F.first("bits").alias("bits"), F.min("key").alias("key"))
    unique = store(unique.select(F.monotonically_increasing_id().alias("node"), "tag", "key", "bits"), "similar-texts")

    near = connected_components(proposals(unique, similarity))
    members = near.select("node", F.col("root").alias("grp")).unionByName(near.select(F.col("root").alias("node"), F.col("root").alias("grp")).distinct())
    wanted = store(members.join(unique.select("node", "key"), "node"), "similar-wanted")
    release_shuffles(spark)
    named = texts.select("key", "text").join(small(wanted), "key").dropDuplicates(["node"])
    sets = store(map_texts(named, ["node", "grp"], ["text"], lambda t: {"s": [x.tobytes() for x in shingle_sets(t, shingle)]}, {"s": "binary"}), "similar-sets")
    release_shuffles(spark)

    # each group's chunks, and those of a large one dealt in another way too
    dealt = sets.join(_measured(sets, "grp").select("grp", "chunks"), "grp").withColumn("label", F.col("node"))
    ways = F.when(F.col("chunks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    part = F.xxhash64("grp", "way", F.pmod(F.xxhash64("node", "way"), F.col("chunks")))
    links = _compared(dealt.withColumn("way", F.explode(ways)).withColumn("part", part), similarity, "similar-links")
    roots = connected_components(links)
    large = dealt.filter("chunks > 1").select("node", "grp", "s")
    if not large.isEmpty():
        labelled = large.join(roots, "node", "left").select("node", "grp", "s", F.coalesce("root", "node").alias("label"))
        more = _compared(_across(store(labelled, "similar-labelled")), similarity, "similar-links")
        roots = connected_components(more.unionByName(roots.toDF("a", "b")))
    release_shuffles(spark)
    nodes = rows.select("doc_id", "key", "tag").join(unique.select("node", "tag"), "tag").join(roots, "node", "left")
    return store(nodes.select("doc_id", "key", "tag", F.coalesce("root", "node").alias("root")), "similar-placed")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, component_id (the least doc_id of its group) of every row.

    Links are all pairs whose five-word shingles are similar by exact count; a
    text of fewer words is one shingle, and texts without words are alike. Null
    ids never name a component. An empty table gives an empty result; further
    columns are ignored.
    """
    placed = similar_rows(docs, similarity, shingle)
    least = store(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "similar-least")
    return placed.join(least, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The documents left when each group of near copies keeps one row, all columns kept.

    That row has the least doc_id, null ids last; of unlike texts with that id
    the one with the least digest stays, of repeated rows one. Null and empty
    texts count as one text. An empty table gives an empty result.
    """
    placed = similar_rows(docs, similarity, shingle)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag", "key").alias("s"))
    key = fresh(docs, "row")
    kept = placed.groupBy("root").agg(first.alias("s")).select(F.col("s.key").alias("key"), F.lit(True).alias("stays"))
    times = placed.groupBy("key").agg(F.count("*").alias("n")).join(kept, "key", "left").withColumnRenamed("key", key)
    marked = store(times.filter("stays IS NULL OR n > 1"), "similar-marked")
    named = docs.withColumn(key, row_key())
    once = named.join(small(marked.select(key)), key, "left_anti").select(*docs.columns)
    again = marked.filter("stays").select(key)
    if again.isEmpty():
        return once
    rank = fresh(docs, "nth")
    one = F.row_number().over(Window.partitionBy(key).orderBy(F.length("text")))
    repeated = named.join(small(again), key, "left_semi").withColumn(rank, one).filter(F.col(rank) == 1)
    return once.unionByName(repeated.select(*docs.columns))
