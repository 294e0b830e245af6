"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node with an edge to another; root is the component's least node.

    `edges` has two columns a and b of one ordered type. Loops, repeated edges
    and either direction are fine; nulls are left out. Each round joins edges
    with each node's least neighbour, both from tables, so that Spark can split
    a hub's rows.
    """
    ordered = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = store(ordered.distinct(), "components-edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        large = _large_star(now)
        drop_stored(now)
        after = _small_star(large)
        drop_stored(large)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself; an edge may come twice."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-least")
    out = store(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "components-large")
    drop_stored(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    least = store(edges.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = store(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components-small")
    drop_stored(least)
    return out
