"""Deduplication and merging of records. `ord` is the arrival position throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import store
from ..functions.text import normalize_doi, text_or_empty, title_key


def first_by_key(df: DataFrame, key: Column, ord: str = "ord") -> DataFrame:
    """The first record of each key, unmerged. The window keeps one row a task before the shuffle."""
    w = Window.partitionBy("__key").orderBy(ord)
    return df.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__key", "__n")


def venue_key(doi: Column | str, title: Column | str) -> Column:
    """The DOI, else the title's word characters."""
    d = normalize_doi(doi)
    return F.when(d != "", F.concat(F.lit("d:"), d)).otherwise(F.concat(F.lit("t:"), title_key(title, "")))


def first_by_doi(df: DataFrame, doi: str = "doi", ord: str = "ord") -> DataFrame:
    """The first record of each DOI; records without one all stay."""
    blank = normalize_doi(doi) == ""
    return first_by_key(df.filter(~blank), normalize_doi(doi), ord).unionByName(df.filter(blank))


def ordered_distinct(df: DataFrame, by: list[str], value: str, ord: str, name: str) -> DataFrame:
    """by, name: each group's distinct values in order of first occurrence."""
    first = df.groupBy(*by, value).agg(F.min(ord).alias("__first"))
    return first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__first", value))), lambda s: s[value]).alias(name))


def _filled(c: str, dtype: str) -> str:
    if dtype == "string":
        return f"{c} IS NOT NULL AND {c} <> ''"
    if dtype.startswith(("array", "map")):
        return f"size({c}) > 0"
    if dtype in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return f"{c} IS NOT NULL AND {c} <> 0"
    return f"{c} IS NOT NULL" if dtype != "boolean" else f"coalesce({c}, false)"


def merge_records(df: DataFrame, key: str = "stable_id", ord: str = "ord") -> DataFrame:
    """One record for each key, merged in arrival order.

    `source` is the ordered distinct list joined by `;`. `abstract` is the
    longest (in characters), the earliest of equals, and `abstract_source` that
    record's or, if it has none, the first one after it. Every other column is
    its first filled value, else the last that is not null. Aggregates alone
    do this, so a hot key costs one row from each task; no group is collected,
    only its distinct sources. The keyed records are stored once, so what their
    keys cost is paid once, and the passes over sources read narrow columns.
    """
    columns = df.columns
    df = store(df.withColumn("__length", F.length(text_or_empty("abstract"))), "merge-records")
    others = [c for c, _ in df.dtypes if c not in (key, ord, "source", "abstract", "abstract_source", "__length")]
    kinds = dict(df.dtypes)
    place = F.struct("__length", -F.col(ord))
    winner = F.max_by(F.struct(text_or_empty("abstract").alias("abstract"), text_or_empty("abstract_source").alias("abstract_source")), place).alias("won")
    kept = [F.coalesce(F.expr(f"min_by({c}, {ord}) FILTER (WHERE {_filled(c, kinds[c])})"), F.expr(f"max_by({c}, {ord}) FILTER (WHERE {c} IS NOT NULL)")).alias(c) for c in others]
    merged = df.groupBy(key).agg(F.min(ord).alias(ord), winner, *kept)
    # one narrow pass for the distinct sources and the place of the winner; lengths find it, no text is read again
    best = F.max_by(F.struct(F.col(ord).alias("at"), (text_or_empty("abstract_source") == "").alias("bare")), place)
    part = df.select(key, ord, "abstract_source", "__length", F.explode(F.split(text_or_empty("source"), ";")).alias("source"))
    part = part.groupBy(key, "source").agg(F.min(ord).alias("__first"), best.alias("best"), F.max(place).alias("place"))
    listed = F.collect_list(F.when(F.col("source") != "", F.struct("__first", "source")))  # nulls are not collected
    facts = part.groupBy(key).agg(F.transform(F.sort_array(listed), lambda s: s["source"]).alias("sources"), F.max_by("best", "place").alias("best"))
    # a winner without a source of its abstract takes the first one of a later record
    bare = facts.filter("best.bare").select(key, F.col("best.at").alias("__at"))
    later = df.join(bare, key).filter(f"{ord} > __at AND coalesce(abstract_source, '') <> ''").groupBy(key).agg(F.min_by("abstract_source", ord).alias("__later"))
    out = merged.join(facts, key, "left").join(later, key, "left")
    chosen = {
        "source": F.coalesce(F.array_join("sources", ";"), F.lit("")),
        "abstract": F.col("won.abstract"),
        "abstract_source": F.when(F.col("won.abstract_source") != "", F.col("won.abstract_source")).otherwise(F.coalesce("__later", F.lit(""))),
    }
    return out.select(*[chosen[c].alias(c) if c in chosen else F.col(c) for c in columns])
