"""SimHash near-dedup with bit-sliced comparison.

Equal fingerprints collapse first, so a group of exact copies costs one row. Of
b blocks that the 64 bits are cut into, two fingerprints within the radius r
share b - r at least; each choice of b - r blocks is a key, and only
fingerprints with a common key meet. A set that meets is compared with itself
in vertical form: bit planes of 64 fingerprints a word, distances counted by
carry-save adders, and a block is abandoned once all its counters exceed the
radius. Only a spanning forest of the links found leaves a task; components
join them. Keys with many fingerprints are split into chunks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, store
from .components import connected_components

#: Fingerprints of one key that meet in one task; larger sets are split into chunks of half.
MEET = 4096


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows have each bit, of rows of 64-bit words; summed in bytes, 255 rows at a time."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    parts = np.add.reduce(bits[:whole].reshape(-1, 255, bits.shape[1]), axis=1, dtype=np.uint8)
    return parts.sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def fingerprint(text: str, shingle: int = 4) -> int:
    """64 bits by majority over the XXH64 (seed 42) of word shingles, as a signed integer."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest, starts = xxhash.xxh64_intdigest, starts[:n].tolist()
    for lo in range(0, n, 16384):
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[lo : lo + 16384], last[lo : lo + 16384], strict=True)), np.uint64)
        counts += bit_counts(hashes[:, None])
    majority = np.packbits(2 * counts > n, bitorder="little")
    return int(majority.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_texts(texts, ["doc_id"], ["text"], lambda t: {"fp": [fingerprint(x, shingle) for x in t]}, {"fp": "long"})


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of 64-bit words): row i holds bit i of all, 64 lanes a word."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64 * fps.shape[1]), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def bit_sliced_pairs(fps: np.ndarray, radius: int, first: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of fingerprints that differ in at most `radius` bits.

    With first = (planes, limit) a pair is also abandoned if more than `limit` of
    the first planes differ, and the distances of the few pairs left are counted
    from whole fingerprints.
    """
    if first:
        a, b = bit_sliced_pairs(np.ascontiguousarray(fps[:, : -(-first[0] // 64)]) & _low_bits(first[0]), first[1])
        near = [np.bitwise_count(fps[a[i : i + 65536]] ^ fps[b[i : i + 65536]]).sum(1) <= radius for i in range(0, len(a), 65536)]
        kept = np.concatenate(near) if near else np.empty(0, bool)
        return a[kept], b[kept]
    vertical = planes(fps)
    vertical = vertical[: np.flatnonzero(vertical.any(1)).max(initial=-1) + 1]  # planes of zeros tell nothing
    n, lanes = len(fps), vertical.shape[1]
    width = (radius + 1).bit_length()
    every = max(8, len(vertical) // 16)
    left, right = [], []
    step = max(1, 1 << 16 >> max(0, lanes - 1).bit_length())
    for lo in range(0, n, step):
        rows = np.arange(lo, min(n, lo + step))
        counters = np.zeros((width, len(rows), lanes), np.uint64)
        over = np.zeros((len(rows), lanes), np.uint64)
        for bit in range(len(vertical)):
            flip = -((fps[rows, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)).astype(np.int64)
            carry = vertical[bit][None, :] ^ flip.view(np.uint64)[:, None]
            for c in counters:
                c ^= carry
                carry = carry & ~c  # a counter bit that fell from 1 to 0 carries on
            over |= carry
            if (bit + 1) % every == 0 and bit > radius:
                over |= _exceeds(counters, radius)
                alive = ~(over == np.uint64(2**64 - 1)).all(1)
                if not alive.any():
                    break
                if alive.sum() < len(rows) // 2:
                    rows, counters, over = rows[alive], counters[:, alive], over[alive]
        else:
            near = ~(over | _exceeds(counters, radius))
            i, word = np.nonzero(near)
            bits = np.unpackbits(near[i, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(bits)
            a, b = rows[i[k]], word[k] * 64 + lane
            keep = (a < b) & (b < n)
            left.append(a[keep])
            right.append(b[keep])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _low_bits(n: int) -> np.ndarray:
    """A mask of the n lowest bits, in 64-bit words."""
    return np.array([min(2**64 - 1, 2 ** max(0, n - 64 * i) - 1) for i in range(-(-n // 64))], np.uint64)


def _exceeds(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius, by comparison from the highest bit down."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], 2**64 - 1)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same = same & counters[i]
        else:
            more = more | same & counters[i]
            same = same & ~counters[i]
    return more


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each position reaches over the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(radius: int, first: tuple[int, int] | None):
    def linked(nodes: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        nodes, at = np.unique(nodes, return_index=True)
        root = forest(len(nodes), *bit_sliced_pairs(fps[at], radius, first))
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[at], "b": nodes[root[at]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of their set; sets are gathered into blocks, and none is parted."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, last = 0, None
        for pdf in batches:
            nodes, names = pdf["node"].to_numpy(), pdf["part"].to_numpy()
            fps = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), -1)
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for s, e in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if names[s] != last and rows >= 512:
                    yield linked(*map(np.concatenate, zip(*held, strict=True)))
                    held, rows = [], 0
                last = names[s]
                held.append((nodes[s:e], fps[s:e]))
                rows += e - s
        if held:
            yield linked(*map(np.concatenate, zip(*held, strict=True)))

    return run


def meet(keyed: DataFrame, radius: int, name: str, first: tuple[int, int] | None = None) -> DataFrame:
    """Links a, b among the nodes that share a key: a spanning forest of each set. keyed: node, bits (the fingerprint's bytes), key.

    A key with more than MEET nodes is split into chunks, and each pair of chunks
    is a set of its own. The keys are made anew for each step, which is cheaper
    than to store them.
    """
    often = store(keyed.groupBy("key").count().filter(F.col("count") > MEET), f"{name}-often")
    sets = keyed.select("node", "bits", F.col("key").alias("part"))
    if not often.isEmpty():
        chunks = F.ceil(F.col("count") / (MEET // 2)).cast("int")
        split = keyed.join(often, "key").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        part = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        sets = keyed.join(often, "key", "left_anti").select("node", "bits", F.col("key").alias("part")).unionByName(split.select("node", "bits", part.alias("part")))
    dealt = sets.repartition("part").sortWithinPartitions("part")
    return dealt.mapInPandas(_links(radius, first), "a long, b long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """The bits of each choice of blocks - radius blocks, as signed 64-bit masks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    each = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cut, cut[1:], strict=False)]
    masks = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def near_links(unique: DataFrame, radius: int = 4) -> DataFrame:
    """Links a, b between the 64-bit fingerprints of column fp that keep all their components together."""
    n = unique.count()
    # more blocks make more keys and smaller sets: about 32 chance meetings at most
    blocks = next((b for b in range(radius + 1, radius + 5) if n / 2 ** (64 * (b - radius) // b) <= 32), radius + 4)
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(block_masks(radius, blocks))])
    keyed = unique.select(F.col("fp").alias("node"), _little_endian("fp").alias("bits"), F.explode(keys).alias("key"))
    return meet(keyed, radius, "simhash")


def _little_endian(c: str) -> Column:
    """The eight bytes of a long, lowest first."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * i, 2) for i in range(8)]))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) of every row.

    Texts without words (null ones too) have fingerprint zero and are linked like
    any other; fewer words than a shingle make one shingle; very long texts are
    hashed whole, in portions. Repeated rows and
    ties share a component. Null ids never name a component: one of null ids
    only has a null component_id. An empty table gives an empty result; further
    columns are ignored.
    """
    rows = store(fingerprints(docs, shingle), "simhash-rows")
    unique = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-unique")
    roots = connected_components(near_links(unique, radius)).withColumnRenamed("node", "fp")
    linked = store(unique.join(roots, "fp"), "simhash-linked")
    root_least = store(unique.withColumnRenamed("fp", "root").join(linked.select("root").distinct(), "root").unionByName(linked.select("root", "least")).groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    members = linked.join(root_least, "root").select("fp", "component_id").unionByName(root_least.withColumnRenamed("root", "fp"))
    named = store(unique.join(members, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "simhash-named")
    return rows.join(named, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
