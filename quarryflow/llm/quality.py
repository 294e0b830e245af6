"""Quality classifier: supervised subword embeddings.

A document's features are its words, its pairs of neighbouring words, the
character n-grams of its text and, as text that repeats itself is a common sort of
junk which no single n-gram shows, a mark for each word that equals one of the
two before it, all hashed into buckets. Every bucket has a learned vector; a document is
the average of its vectors, a linear layer and a softmax give the probability of
each class, and numpy stochastic gradient descent trains both.

Scoring uses that the logits are linear in the average: each bucket's vector
times the output layer is one number for two classes, so a task gathers and
averages numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh
from .rolling import U, Words, in_portions, mix


@dataclass(frozen=True)
class Settings:
    """Parameters. A fit holds some ten bytes on the driver for each character of its sample, 2 * sample_chars and one document of a class at most."""

    sample_per_class: int = 1000
    sample_chars: int = 2_500_000
    buckets: int = 1 << 17
    width: int = 12
    epochs: int = 6
    rate: float = 0.6
    ngrams: tuple[int, ...] = (3, 4, 5)
    seed: int = 7


_GRAM, _PAIR, _AGAIN = 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0x8CB92BA72F3D8DD7


def feature_ids(texts: list[str], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of features as (text number, bucket), of all texts together."""
    w = Words(texts)
    mask = U(s.buckets - 1)
    if len(w.hash):
        yield w.doc, w.hash & mask
        together = w.doc[1:] == w.doc[:-1]
        yield w.doc[1:][together], mix(w.hash[1:] * U(_PAIR) + w.hash[:-1])[together] & mask
        for back in (1, 2):
            again = (w.doc[back:] == w.doc[:-back]) & (w.hash[back:] == w.hash[:-back])
            yield w.doc[back:][again], np.full(int(again.sum()), mix(np.array([_AGAIN + back], U))[0] & mask)
    points = w.points.astype(U)
    number = np.repeat(np.arange(len(texts)), np.diff(w.first))
    for n in s.ngrams:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, U)
        for j in range(n):
            h = h * U(_GRAM) + points[j : j + m]
        inside = number[:m] == number[n - 1 :]
        # the space between two texts belongs to neither
        inside &= np.arange(m) + n < w.first[number[:m] + 1]
        yield number[:m][inside], mix(h)[inside] & mask


def _balanced(docs: DataFrame, labels: DataFrame, learn: Column, s: Settings) -> DataFrame:
    """Up to sample_per_class labelled documents of each class with up to sample_chars characters, by the hash of their ids; of rows with one id the least text."""
    known = labels.filter(learn & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q = 0 OR q = 1")
    part = [known.filter(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_per_class) for q in (0, 1)]
    chosen = part[0].unionByName(part[1])  # 2 * sample_per_class rows at most, so it can be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    whole = rows.groupBy("doc_id", F.col("q").cast("int").alias("q")).agg(F.min("text").alias("text"))
    # one document of a tenth of the bound or more must not keep all others out, so these come last
    order = Window.partitionBy("q").orderBy(F.length("text") * 10 > s.sample_chars, F.xxhash64("doc_id"), "doc_id")
    upto = whole.withColumns({"upto": F.sum(F.length("text")).over(order), "place": F.row_number().over(order)})
    taken = upto.filter((F.col("upto") <= s.sample_chars) | (F.col("place") == 1)).select("doc_id", "q", "text")
    return taken.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")


@dataclass
class Model:
    weights: np.ndarray  # one logit for each bucket
    bias: float
    settings: Settings

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in in_portions(texts):
            total, n = np.zeros(hi - lo), np.zeros(hi - lo)
            for doc, ids in feature_ids(texts[lo:hi], self.settings):
                total += np.bincount(doc, self.weights[ids], hi - lo)
                n += np.bincount(doc, minlength=hi - lo)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -40, 40)))
        return out


def train(documents: list[tuple[np.ndarray, np.ndarray]], classes: list[int], s: Settings) -> Model:
    """Gradient descent, a document a step. A document is its distinct buckets and their shares."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.width, 1 / s.width, (s.buckets, s.width)).astype(np.float32)
    out, bias = np.zeros((s.width, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(classes, minlength=2) / max(1, len(classes))
    steps, step = max(1, s.epochs * len(documents)), 0
    for _ in range(s.epochs if min(share) > 0 else 0):
        for i in rng.permutation(len(documents)):
            ids, part = documents[i]
            rate = np.float32(s.rate * (1 - step / steps))
            step += 1
            if not len(ids):
                continue
            hidden = part @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[classes[i]] -= 1
            p *= np.float32(0.5 / share[classes[i]])
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.1) * p
            # a document moves its vectors by their shares; the share of one is raised so that rare buckets learn
            vectors[ids] -= rate * np.outer(np.minimum(part * len(ids), 10) / np.sqrt(len(ids)), back).astype(np.float32)
    logits = vectors @ (out[:, 1] - out[:, 0])
    return Model(logits.astype(np.float64), float(bias[1] - bias[0]), s)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, settings: Settings = Settings()) -> Model:
    """Learns from a bounded sample of labelled rows that `learn` allows.

    Features are hashed on the executors; the driver gets each sampled
    document's distinct buckets with their counts. The sample is bounded in rows
    and in characters: of each class it takes, in the order of the hash of their
    ids, up to sample_per_class documents while these have sample_chars
    characters at most; a document is taken whole or not at all. Rows with null labels, or
    labels other than 0 and 1, and ids with both labels teach nothing. Without
    rows of both classes every score is 0.5.
    """
    s = settings

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            ids, counts = [], []
            for t in texts:
                total = np.zeros(s.buckets, np.int32)
                for _, f in feature_ids([t], s):
                    total += np.bincount(f.astype(np.int64), minlength=s.buckets).astype(np.int32)
                at = np.flatnonzero(total)
                ids.append(at.astype(np.int32).tobytes())
                counts.append(total[at].tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "q": pdf["q"], "ids": ids, "counts": counts})

    allowed = F.lit(True) if learn is None else learn
    rows = _balanced(docs, labels, allowed, s).mapInPandas(features, "doc_id long, q int, ids binary, counts binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("q", "ascending"), ("ids", "ascending")])
    documents = []
    ids = counts = None
    for ids, counts in zip(rows["ids"], rows["counts"], strict=True):
        c = np.frombuffer(counts.as_buffer(), np.int32)
        documents.append((np.frombuffer(ids.as_buffer(), np.int32).copy(), (c / max(1, c.sum())).astype(np.float32)))
    classes = rows["q"].to_pylist()
    del rows, ids, counts
    return train(documents, classes, s)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from the training: crc32 of its id as text, modulo 4, is 2. Null ids are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of `docs` and the score and prediction under `names`; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each bucket, whatever the input

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(shared.value.scores(t.tolist()))

    scored = docs.withColumn(names[0], probability(F.coalesce("text", F.lit(""))))
    return scored.withColumn(names[1], F.when(F.col(names[0]) >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """The documents that score `threshold` or more, all columns kept; labels are learnt from rows not held out.

    Without both classes among the labels nothing tells good from bad and every
    document scores 0.5, so none stays.
    """
    names = (fresh(docs, "score"), fresh(docs, "predicted"))
    return score(docs, fit(docs, labels, ~held_out(), settings), threshold, names).filter(F.col(names[1]) == 1).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Labels are learnt from rows that are not held out; a score depends on the
    text alone, so ties and repeated rows score alike. Null and empty texts get
    the score of no features; a very long text is scored whole. An empty table gives an empty result; further
    columns are ignored.
    """
    model = fit(docs, labels, ~held_out(), settings)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
