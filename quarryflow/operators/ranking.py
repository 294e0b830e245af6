"""Scores, ranks, capacity selection and report orders."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import with_positions
from ..functions.text import cosine, whole_date

#: The priorities in order.
PRIORITIES = ("A", "B", "C", "D", "Ignore")


def with_cosine(df: DataFrame, query: Column, vector: str = "embedding") -> DataFrame:
    """Adds semantic_score: similarity to one query vector, in 0..1, rounded to six places."""
    return df.withColumn("semantic_score", F.round(cosine(F.col(vector), query), 6))


def with_semantic_rank(df: DataFrame, ord: str = "ord") -> DataFrame:
    """Adds semantic_rank from 1, by score (null as 0), ties in arrival order.

    Ranges of the order and their totals give the ranks, so no task sorts all rows.
    """
    keyed = df.withColumn("__by", -F.coalesce("semantic_score", F.lit(0.0)))
    placed = with_positions(keyed, ["__by", ord], name="semantic-rank")
    return placed.withColumn("semantic_rank", (F.col("row_pos") + 1).cast("int")).drop("__by", "row_pos")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Each group's first k rows; Spark limits each task's groups before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def select_capacity(df: DataFrame, caps: dict[str, int], weekly: int, ord: str = "ord") -> DataFrame:
    """The reading queue: the best of priorities A, B and C up to their caps, then the first `weekly`.

    Within a priority higher relevance goes first, then the higher semantic
    score (null as 0), then arrival.
    """
    score = F.coalesce(F.col("semantic_score"), F.lit(0.0))
    order = [F.desc("relevance_score"), score.desc(), F.col(ord)]
    n, cap = F.col("__n"), F.lit(0)
    for p in ("A", "B", "C"):
        cap = F.when(F.col("priority") == p, caps.get(p, 0)).otherwise(cap)
    placed = df.filter(F.col("priority").isin("A", "B", "C")).withColumn("__n", F.row_number().over(Window.partitionBy("priority").orderBy(*order)))
    # the constant bound lets each task keep its best rows alone before the shuffle
    few = placed.filter((n <= max(caps.values(), default=0)) & (n <= cap)).drop("__n")
    return few.orderBy("priority", *order).limit(weekly)


def priority_rank(p: Column) -> Column:
    out = F.lit(5)
    for i, name in enumerate(PRIORITIES):
        out = F.when(p == name, i).otherwise(out)
    return out


def report_order(ord: str = "ord") -> list[Column]:
    """Priority, then relevance from high to low, then the date's text from low to high."""
    return [priority_rank(F.col("priority")), F.desc("relevance_score"), F.col("publication_date"), F.col(ord)]


def within_days(published: Column, reference: Column, days: int) -> Column:
    """0 <= reference - published <= days; 0 days means all, and dates that cannot be read pass."""
    gap = F.datediff(reference, whole_date(published))
    return F.lit(True) if days == 0 else gap.isNull() | gap.between(0, days)


def window_bounds(from_date: str | None, to_date: str | None, days: int, today: str) -> tuple[str, str]:
    """The discovery window; an error if it is empty."""
    end = date.fromisoformat(to_date or today)
    start = date.fromisoformat(from_date) if from_date else end - timedelta(days=days)
    if start > end:
        raise ValueError("from_date must not be after to_date")
    return start.isoformat(), end.isoformat()
