"""Exact top-k by integer inner product, with a pivot table.

Every vector's distances to a few pivot rows are precomputed. For a query q and
a row x the triangle inequality gives |q - x| >= max over pivots of
|d(q, p) - d(x, p)|, hence <q, x> <= (|q|^2 + |x|^2 - bound^2) / 2. Candidates are
evaluated in falling order of that upper bound until it drops below the k-th
best score, so nothing that could enter the result is skipped.

Rows lie in the cell of their nearest pivot (of the first few), large cells in several blocks, and
stay there. Every query first searches one block of its own cell, which gives it
a floor, the score that a k-th best row has at least. Then it goes to the blocks
of those cells alone whose ranges of distances allow the floor. A task holds one
block and lets the queries pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Rows that the pivots are chosen from, at most. Any choice gives exact results.
PIVOT_SAMPLE = 2000
#: Blocks that the rows are cut into, while these have so many rows at least and at most.
BLOCKS, LEAST_ROWS, MOST_ROWS = 64, 4096, 1 << 17


def quantised(vectors: DataFrame) -> DataFrame:
    """uid, vec_id and the components as floor(256 * x); unusable vectors are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return vectors.filter(usable).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), q.alias("q"))


def farthest_first(sample: np.ndarray, m: int) -> np.ndarray:
    """Positions of up to m rows far from each other."""
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(m, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def matrix(rows: list, width: int) -> np.ndarray:
    """Vectors (the bytes of their int64 components) as float64 rows, short ones filled with zeros. Whole numbers up to 2^53 are exact."""
    whole = [np.frombuffer(r, np.int64) for r in rows]
    if all(len(r) == width for r in whole):
        return np.array(whole, np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(whole):
        out[i, : len(r)] = r
    return out


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether products of whole-numbered a and b are exact as floats."""
    return not (a.size and b.size) or np.abs(a).max() * np.abs(b).max() * a.shape[-1] < 2**53


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-numbered a and b, by floats where they are exact."""
    return (a @ b).astype(np.int64) if exact(a, b) else a.astype(np.int64) @ b.astype(np.int64)


def distances(v: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (seeds * seeds).sum(1) - 2 * (v @ seeds.T), 0)).astype(np.float32)


class Block:
    """Rows of one cell, and the search among them."""

    def __init__(self, x: np.ndarray, uid: np.ndarray, vec_id: np.ndarray, piv: np.ndarray, k: int):
        self.x, self.uid, self.vec_id, self.piv, self.k = x, uid, vec_id, piv, k
        self.norm, self.most = (x * x).sum(1), np.abs(x).max(initial=0)
        # float errors never raise a lower bound
        self.slack = 1e-6 * piv.max(1, initial=0) + 1e-7 * np.sqrt(self.norm)

    def top(self, q: np.ndarray, uid: int, piv: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows for a query that score `floor` or more."""
        norm = float(q @ q)
        low = np.abs(self.piv - piv).max(1, initial=0) - self.slack - 1e-6 * piv.max(initial=0) - 1e-7 * norm**0.5
        low = np.maximum(low, 0)
        upper = (norm + self.norm - low * low) / 2 + 1e-9 * (norm + self.norm) + 1
        live = np.flatnonzero((upper >= floor) & (self.uid != uid))
        order = live[np.argsort(-upper[live], kind="stable")]
        whole = self.most * np.abs(q).max(initial=0) * len(q) < 2**53
        got, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 64
        while at < len(order) and upper[order[at]] >= floor:
            part = order[at : at + step]
            at, step = at + step, 1024
            found = (self.x[part] @ q).astype(np.int64) if whole else self.x[part].astype(np.int64) @ q.astype(np.int64)
            near = found >= floor
            got, scores = np.concatenate((got, part[near])), np.concatenate((scores, found[near]))
            best = np.lexsort((self.vec_id[got], -scores))[: self.k]
            got, scores = got[best], scores[best]
            if len(got) == self.k:
                floor = max(floor, scores[-1])
        return got, scores


def _search(width: int, k: int):
    """Rows come in order of their block, the block's own rows before the queries that visit it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        at, block = None, None
        for pdf in batches:
            names, visits = pdf["block"].to_numpy(), pdf["visit"].to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (visits[1:] != visits[:-1])) + 1
            out: dict[str, list] = {"query_uid": [], "query_id": [], "vec_id": [], "score": []}
            for s, e in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                part = pdf.iloc[s:e]
                if names[s] != at:
                    at, held, block = names[s], [], None
                if not visits[s]:
                    held.append(part)
                    continue
                if block is None and held:
                    rows = pd.concat(held)
                    held, piv = [], np.frombuffer(b"".join(rows["piv"]), np.float32).reshape(len(rows), -1)
                    block = Block(matrix(rows["q"].tolist(), width), rows["uid"].to_numpy(), rows["vec_id"].to_numpy(), piv, k)
                if block is None:
                    continue
                q, piv = matrix(part["q"].tolist(), width), np.frombuffer(b"".join(part["piv"]), np.float32).reshape(len(part), -1)
                for i, (uid, vec_id, floor) in enumerate(zip(part["uid"], part["vec_id"], part["floor"], strict=True)):
                    got, scores = block.top(q[i], uid, piv[i], floor)
                    out["query_uid"] += [uid] * len(got)
                    out["query_id"] += [vec_id] * len(got)
                    out["vec_id"] += block.vec_id[got].tolist()
                    out["score"] += scores.tolist()
            yield pd.DataFrame(out)

    return run


FOUND = "query_uid long, query_id long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = 32, row_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates are
    all other rows, the query's own row (not its id) left out, so repeated rows
    find each other. Vectors null, or holding null or non-finite components, and
    rows with a null id take no part; an empty vector scores zero; vectors of
    unlike length are compared as if the shorter one ended in zeros. Fewer than
    k candidates give fewer rows, an empty table none. Scores are 64-bit
    integers and must fit in them. Further columns are ignored.
    """
    rows = store(quantised(vectors), "topk-vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(width or 1, 1)
    # a query is sent to the blocks it visits: as many blocks as keep BLOCKS tasks busy, while a task can hold one
    row_block = row_block or min(MOST_ROWS, max(LEAST_ROWS, n // BLOCKS))
    n_cells = max(1, min(pivots, n // row_block))  # cells of about a block each, while there are pivots
    sample = rows.orderBy(F.xxhash64("vec_id"), "uid").limit(PIVOT_SAMPLE).toPandas()
    points = matrix([np.array(v, np.int64).tobytes() for v in sample["q"]], width)
    chosen = farthest_first(points, pivots) if len(points) else np.empty(0, int)
    seeds, seed_uid = points[chosen], sample["uid"].to_numpy()[chosen] if len(points) else np.empty(0, int)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = [np.asarray(v, np.int64).tobytes() for v in pdf["q"]]
            v = matrix(whole, width)
            d = distances(v, seeds)
            # the k-th best score among the pivots, which are rows too
            scores = inner(v, seeds.T).astype(np.float64)
            scores[pdf["uid"].to_numpy()[:, None] == seed_uid] = -np.inf
            floor = np.sort(scores, 1)[:, -k] if scores.shape[1] >= k else np.full(len(v), -np.inf)
            cell = d[:, :n_cells].argmin(1) if d.shape[1] else np.zeros(len(v))
            yield pd.DataFrame({"uid": pdf["uid"], "vec_id": pdf["vec_id"], "q": whole, "piv": [x.tobytes() for x in d], "cell": cell.astype(np.int32), "norm": (v * v).sum(1), "floor": floor})

    # the pivot table, stored
    known = store(rows.mapInPandas(measure, "uid long, vec_id long, q binary, piv binary, cell int, norm double, floor double"), "topk-pivots")

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each batch and cell the rows, the largest norm and the least and greatest distance to each pivot."""
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                piv = np.frombuffer(b"".join(part["piv"]), np.float32).reshape(len(part), -1)
                low, high = (f(piv, 0).astype(np.float64).tolist() if piv.size else [] for f in (np.min, np.max))
                yield pd.DataFrame({"cell": [cell], "n": [len(part)], "norm": [part["norm"].max()], "low": [low], "high": [high]})

    m = len(seeds)
    spans = known.select("cell", "piv", "norm").mapInPandas(ranges, "cell int, n long, norm double, low array<double>, high array<double>")
    ends = [f(F.get(c, i)).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(m)]
    cells = spans.groupBy("cell").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), *ends).orderBy("cell").collect()  # a row for each pivot at most
    cell_ids, cell_norm = np.array([c.cell for c in cells], np.int32), np.array([c.norm for c in cells])
    low, high = (np.array([[c[f"{end}{i}"] for i in range(m)] for c in cells]).reshape(len(cells), m) for end in ("low", "high"))
    parts = {c.cell: -(-c.n // row_block) for c in cells}
    n_parts = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else F.create_map().cast("map<int,int>")

    def block(cell: Column, part: Column) -> Column:
        return cell.cast("long") * (1 << 32) + part

    own = F.pmod(F.xxhash64("uid"), n_parts[F.col("cell")]).cast("int")
    placed = known.select(block(F.col("cell"), own).alias("block"), F.lit(False).alias("visit"), "uid", "vec_id", "q", "piv", F.lit(0.0).alias("floor"))
    queries = known.filter(F.col("vec_id") % every == 0)

    def searched(visits: DataFrame) -> DataFrame:
        both = placed.unionByName(visits.select("block", F.lit(True).alias("visit"), "uid", "vec_id", "q", "piv", "floor"))
        return both.repartition("block").sortWithinPartitions("block", "visit").mapInPandas(_search(width, k), FOUND)

    some = searched(queries.withColumn("block", block(F.col("cell"), own)))
    kth = Window.partitionBy("query_uid").orderBy(F.desc("score"))
    some = some.withColumn("n", F.row_number().over(kth)).filter(F.col("n") == k).select(F.col("query_uid").alias("uid"), F.col("score").cast("double").alias("reached"))
    aimed = queries.join(store(some, "topk-floors"), "uid", "left").withColumn("floor", F.greatest("floor", F.coalesce("reached", F.lit(float("-inf"))))).select("uid", "vec_id", "q", "piv", "norm", "floor")

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that may hold a row of each query's floor."""
        for pdf in batches:
            piv = np.frombuffer(b"".join(pdf["piv"]), np.float32).reshape(len(pdf), -1).astype(np.float64)
            norm, floor = pdf["norm"].to_numpy(), pdf["floor"].to_numpy()
            targets = []
            for i in range(len(pdf)):
                far = np.maximum(np.maximum(piv[i] - high, low - piv[i]).max(1, initial=0), 0)
                slack = 1e-6 * (high.max(1, initial=0) + piv[i].max(initial=0)) + 1e-7 * (np.sqrt(cell_norm) + norm[i] ** 0.5)
                far = np.maximum(far - slack, 0)
                upper = (norm[i] + cell_norm - far * far) / 2 + 1e-9 * (norm[i] + cell_norm) + 1
                targets.append(cell_ids[upper >= floor[i]])
            n = [len(t) for t in targets]
            cols = {c: pdf[c].repeat(n).to_numpy() for c in ("uid", "vec_id", "q", "piv", "floor")}
            yield pd.DataFrame({"cell": np.concatenate(targets) if targets else [], **cols}).astype({"cell": "int32"})

    gone = aimed.mapInPandas(visits, "cell int, uid long, vec_id long, q binary, piv binary, floor double")
    every_part = F.explode(F.sequence(F.lit(0), n_parts[F.col("cell")] - 1))
    found = searched(gone.select("*", every_part.alias("part")).withColumn("block", block(F.col("cell"), F.col("part"))))
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
