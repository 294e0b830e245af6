"""Substring dedup: a sparse de Bruijn graph of token k-mers, compacted by joins.

A window of `window` words is repeated if its word sequence starts at two places
or more. Out of each window's k-mers (k = window // 2 + 1) the one with the least hash
is an anchor; equal windows have equal anchors, so a repeated window has a
repeated anchor. The steps:

1. Edges. Each anchor occurrence leads to the next anchor of its document, at a
   gap of at most k words, so that two anchors and their gap spell all words
   between. An aggregation by anchor counts occurrences and tells whether all of
   them have the same successor.
2. Compaction. A self-join of the repeated anchors finds the nonbranching edges:
   a's only successor is b and b's only predecessor is a. Rounds of joins, each
   doubling the reach, lead every anchor to the head of its path. All
   occurrences of a path spell the same words.
3. Source coordinates. A join takes the paths of `window` words and more back to
   the places where they occur. Other windows with a repeated anchor, at
   branches and path ends, are taken one by one. A digest of the words
   themselves at each of these places verifies them: what repeats has equal
   words twice at least.
4. Each document's spans are joined to its text and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, drop_stored, release_shuffles, slices, store
from .rolling import MOST, Words, in_portions, winnowed


def _anchored(texts: list[str], window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words; the hash of each k-mer, whether it is an anchor; each window's anchor, whether it counts."""
    words = Words(texts)
    k = window // 2 + 1
    h, valid = words.windows(k)
    n = max(0, len(words.hash) - window + 1)
    ok = words.doc[:n] == words.doc[window - 1 :] if n else np.empty(0, bool)
    chosen, least = winnowed(h, valid, ok, window - k + 1)
    return words, h, chosen, least, ok


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, row = batch.column("text").to_pylist(), batch.column("row").to_numpy()
            for lo, hi in in_portions(texts):
                words, h, chosen, _, _ = _anchored(texts[lo:hi], window)
                at = np.flatnonzero(chosen)
                doc, a = words.doc[at], h[at]
                same = doc[1:] == doc[:-1]
                gap = np.zeros(len(at), np.int32)
                gap[:-1] = np.where(same, at[1:] - at[:-1], 0)
                pos = (at - words.doc_from[doc]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"anchor": _signed(a), "row": row[lo:hi][doc], "pos": pos, "gap": gap, "next": _signed(np.concatenate((a[1:], a[:1])))})

    return run


def _paths(anchors: DataFrame, window: int) -> DataFrame:
    """anchor of every repeated anchor; length, in words, for those that head a nonbranching path of a window or more.

    An edge is nonbranching if all n occurrences of a lead to b at one gap, and b
    occurs n times: then each occurrence of b comes from a. Texts end, so there
    are no nonbranching cycles, and the rounds do too.
    """
    nodes = anchors.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("gap").alias("gap"), F.max("gap").alias("gap_most"), F.min("next").alias("next"), F.max("next").alias("next_most")
    )
    nodes = store(nodes.filter("n >= 2"), "substring-nodes")
    one_next = nodes.filter("gap = gap_most AND gap > 0 AND next = next_most")
    left = one_next.select(F.col("anchor").alias("up"), "n", "gap", F.col("next").alias("anchor"))
    edges = left.join(nodes.select("anchor", F.col("n").alias("n_to")), "anchor").filter("n = n_to")
    # each node's ancestor, 1, 2, 4, ... edges up; done once that is the head of the path
    now = store(edges.select("anchor", "up", F.col("gap").cast("long").alias("far"), F.lit(False).alias("done")), "substring-up")
    ended = now.filter("done")
    while not now.filter("NOT done").isEmpty():
        todo = now.filter("NOT done")
        above = ended.unionByName(todo).select(F.col("anchor").alias("up"), F.col("up").alias("higher"), F.col("far").alias("farther"), F.col("done").alias("known"))
        met = todo.join(above, "up", "left")
        far = F.col("far") + F.coalesce("farther", F.lit(0))
        now = store(met.select("anchor", F.coalesce("higher", "up").alias("up"), far.alias("far"), (F.col("higher").isNull() | F.col("known")).alias("done")), "substring-up")
        ended = ended.unionByName(now.filter("done"))
    k = window // 2 + 1
    heads = ended.groupBy(F.col("up").alias("anchor")).agg((F.max("far") + k).alias("length")).filter(F.col("length") >= window)
    return nodes.select("anchor").join(heads, "anchor", "left")


def _digests(words: list[bytes], starts: list[int], ends: list[int]) -> list[bytes]:
    """16 bytes for each stretch of words, of the words themselves."""
    joined = memoryview(b" ".join(words))
    at = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    lo, hi = at[starts].tolist(), (at[ends] - 1).tolist()
    return [hashlib.blake2b(joined[s:e], digest_size=16).digest() for s, e in zip(lo, hi, strict=True)]


def _span_rows(window: int, by_paths: bool):
    """Paths and single windows, each with the digest of its words, of documents with repeated anchors.

    marks hold the place of a repeated anchor in the upper, the length of the
    path that begins there (or zero) in the lower half of a long.
    """
    k = window // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, marks = batch.column("text").to_pylist(), batch.column("marks")
            row = batch.column("row").to_numpy()
            for lo, hi in in_portions(texts):
                words, h, _, least, ok = _anchored(texts[lo:hi], window)
                n = len(ok)
                if not n:
                    continue
                m = [np.sort(marks[lo + d].values.to_numpy()) for d in range(hi - lo)]
                at = np.concatenate([(x >> 32) + words.doc_from[d] for d, x in enumerate(m)])
                length = np.concatenate([x & 0xFFFFFFFF for x in m]) * by_paths
                begin, size = at[length > 0], length[length > 0]
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + size - window + 1, -1)
                repeated = np.zeros(len(h), bool)
                repeated[at] = True
                near = _window_has(repeated, h, least, window - k + 1)
                todo = np.flatnonzero(ok & near & (np.cumsum(depth)[:n] == 0))
                begin, size = np.concatenate((begin, todo)), np.concatenate((size, np.full(len(todo), window)))
                doc = words.doc[begin]
                order = np.argsort(doc, kind="stable")
                begin, size, doc = begin[order], size[order], doc[order]
                start = begin - words.doc_from[doc]
                digest: list[bytes] = []
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1)).tolist()
                for d, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if s < e:
                        digest += _digests(texts[lo + d].encode().split(), start[s:e], start[s:e] + size[s:e])
                yield pa.RecordBatch.from_pydict(
                    {"digest": pa.array(digest, pa.binary()), "path": size > window, "row": row[lo:hi][doc], "start": start.astype(np.int32), "length": size.astype(np.int32)}
                )

    return run


def _window_has(repeated: np.ndarray, h: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Windows whose least k-mer is a repeated anchor of the same batch."""
    return np.isin(least, np.unique(h[repeated])) & (least != MOST)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if spans.is_valid:
                s = spans.values.to_numpy()
                np.add.at(gone, s >> 32, 1)
                np.add.at(gone, (s >> 32) + (s & 0xFFFFFFFF), -1)
            cut = np.cumsum(gone)[:-1] > 0
            kept = b" ".join([w for w, c in zip(words, cut.tolist(), strict=True) if not c] if cut.any() else words)
            n_words.append(len(words))
            n_removed.append(int(cut.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def _with(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a row of `found` joined to them, and those without one.

    Where the numbers of `found` are few enough to broadcast, only texts that
    have one are shuffled.
    """
    if found.count() > MOST_BROADCAST:
        return rows.join(found, "row"), rows.join(found.select("row"), "row", "left_anti")
    numbers = F.broadcast(found.select("row"))
    return rows.join(numbers, "row", "left_semi").join(found, "row"), rows.join(numbers, "row", "left_anti")


def numbered_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: the rows stored under numbers of their own, null texts as empty."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return store(texts.withColumn("row", F.monotonically_increasing_id()), "substring-texts")


def repeated_spans(rows: DataFrame, window: int = 35) -> DataFrame:
    """row, start, length of word spans whose every window of `window` words is repeated.

    rows: row, text. Spans of a row overlap. Together they cover all repeated
    windows and nothing else.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = rows.sparkSession
    rows = rows.select("row", "text")
    anchors = store(rows.mapInArrow(_anchor_rows(window), "anchor long, row long, pos int, gap int, next long"), "substring-anchors")
    graph = store(_paths(anchors, window), "substring-paths")
    release_shuffles(spark)
    mark = F.shiftleft(F.col("pos").cast("long"), 32) + F.coalesce("length", F.lit(0))
    marks = store(anchors.join(graph, "anchor").groupBy("row").agg(F.collect_set(mark).alias("marks")), "substring-marks")
    drop_stored(anchors)
    release_shuffles(spark)

    def found(by_paths: bool) -> DataFrame:
        kinds = "digest binary, path boolean, row long, start int, length int"
        return store(_with(rows, marks)[0].mapInArrow(_span_rows(window, by_paths), kinds), "substring-windows")

    spans = found(True)
    release_shuffles(spark)
    counted = store(spans.groupBy("digest").agg(F.count("*").alias("n"), F.max("path").alias("path")), "substring-counted")
    if not counted.filter("path AND n = 1").isEmpty():
        # anchors of unlike words had one hash: take every window for itself
        spans = found(False)
        counted = store(spans.groupBy("digest").agg(F.count("*").alias("n")), "substring-counted")
    return spans.join(counted.filter("n >= 2"), "digest", "left_semi").select("row", "start", "length")


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text left, words joined by one space).

    Every word covered by a window that also starts elsewhere, in any document
    or the same one, goes; windows are judged on the input. A null text has no
    words; a text shorter than the window loses nothing; a repeated row is
    another place, so both lose all windows, however often it comes. Very long
    texts are taken whole, one at a time. Null ids are rows like any other.
    An empty table gives an empty result; further columns are ignored.
    """
    rows = numbered_rows(docs)
    spans = repeated_spans(rows, window)
    # a row's spans are at most its words
    per_row = spans.groupBy("row").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("length")).alias("spans"))
    per_row = store(per_row, "substring-spans")
    release_shuffles(docs.sparkSession)
    some, others = _with(rows, per_row)
    joined = some.select("doc_id", "text", "spans").unionByName(others.select("doc_id", "text", F.lit(None).cast("array<long>").alias("spans")))
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
