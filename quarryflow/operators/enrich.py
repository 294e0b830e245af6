"""Enrichment: a lookup join that fills what is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_doi, text_or_empty


def enrich(papers: DataFrame, works: DataFrame, ord: str = "ord", name: str = "openalex") -> DataFrame:
    """Papers with the abstract (if theirs is empty) and the topics of the work with their DOI.

    works: doi, abstract, primary_topic, topic_subfield, topic_field, all_topics;
    of several works with one DOI any with the greatest values is taken. Of
    papers that share a DOI only the last one by `ord` receives data.
    """
    topics = ("primary_topic", "topic_subfield", "topic_field", "all_topics")
    found = works.withColumn("__doi", normalize_doi("doi")).filter("__doi <> ''").groupBy("__doi").agg(F.max(F.struct(F.col("abstract").alias("found"), *topics)).alias("w"))
    keyed = papers.drop(*topics).withColumn("__doi", F.nullif(normalize_doi("doi_raw"), F.lit("")))
    # records without a DOI take no part in the shuffles: they would all have one key
    named, bare = keyed.filter("__doi IS NOT NULL"), keyed.filter("__doi IS NULL").drop("__doi")
    # an aggregate tells each DOI's last record: a frequent DOI costs one row from each task
    last = named.groupBy("__doi").agg(F.max(ord).alias("__at"))
    work = last.join(found, "__doi").select("__doi", "__at", "w")
    joined = named.join(work, "__doi", "left").withColumn("w", F.when(F.col(ord) == F.col("__at"), F.col("w")))
    fill = (text_or_empty("abstract") == "") & (text_or_empty("w.found") != "")
    filled = joined.withColumns(
        {
            "abstract_source": F.when(fill, F.lit(name)).otherwise(F.col("abstract_source")),
            "abstract": F.when(fill, F.col("w.found")).otherwise(F.col("abstract")),
            **{t: F.col(f"w.{t}") for t in topics},
        }
    ).drop("__doi", "__at", "w")
    return filled.unionByName(bare, allowMissingColumns=True)
