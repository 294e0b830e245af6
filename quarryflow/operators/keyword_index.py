"""Many keywords at once: one pass of an Aho-Corasick automaton over each text, an Arrow batch at a time.

Literal tests cost keywords times text length and put every keyword into the
plan; an automaton reads a text once, however many keywords there are. Both give
the same hits in the same order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Automaton:
    """Which of some keywords occur in a text, as substrings, by their numbers. Keywords and texts are lower-cased by the caller."""

    def __init__(self, keywords: list[str]):
        import ahocorasick

        self.always = [i for i, k in enumerate(keywords) if not k]
        places: dict[str, list[int]] = {}
        for i, k in enumerate(keywords):
            if k:
                places.setdefault(k, []).append(i)
        self.machine = ahocorasick.Automaton()
        for k, at in places.items():
            self.machine.add_word(k, tuple(at))
        if places:
            self.machine.make_automaton()
        self.some = bool(places)

    def hits(self, text: str) -> list[int]:
        found = set(self.always)
        if self.some:
            for _, at in self.machine.iter(text):
                found.update(at)
        return sorted(found)


def available() -> bool:
    from importlib.util import find_spec

    return find_spec("ahocorasick") is not None


def lowered(spark: SparkSession, keywords: list[str]) -> list[str]:
    """The keywords in lower case as Spark does it, which is how texts are lowered too."""
    rows = spark.createDataFrame(list(enumerate(keywords)), "at int, k string").select("at", F.lower("k").alias("k"))
    return [r.k for r in sorted(rows.collect())]


def all_hits(spark: SparkSession, hay: Column, groups: dict[str, list[str]]) -> Column:
    """A struct of one array for each group: its keywords that occur in the lower-cased text, in the group's order.

    The keywords are a vocabulary that fits the driver; they go to the tasks by one broadcast variable.
    """
    flat = [k for ks in groups.values() for k in ks]
    starts = [0]
    for ks in groups.values():
        starts.append(starts[-1] + len(ks))
    shared = spark.sparkContext.broadcast((lowered(spark, flat), flat))
    names = list(groups)
    made: dict[int, Automaton] = {}  # one for each worker

    @F.pandas_udf(", ".join(f"{n} array<string>" for n in names))
    def find(texts: pd.Series) -> pd.DataFrame:
        low, as_given = shared.value
        machine = made.get(0) or made.setdefault(0, Automaton(low))
        rows = []
        for text in texts:
            hits = machine.hits(text)
            rows.append([[as_given[i] for i in hits if lo <= i < hi] for lo, hi in zip(starts, starts[1:], strict=False)])
        return pd.DataFrame(rows, columns=names)

    return find(hay)
