"""API payloads as records: explicit schemas, and expressions that normalise them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    author_list,
    doi_url,
    first_filled,
    from_inverted_index,
    html_unescape,
    normalize_doi,
    partial_date,
    strip_abstract_label,
    strip_markup,
    text_or_empty,
)
from ..operators.screening import is_research_title

_DATE_PARTS = "struct<`date-parts`: array<array<int>>>"
#: Formats of the three services' items (public APIs).
CROSSREF_ITEM = f"struct<title: array<string>, abstract: string, `published-print`: {_DATE_PARTS}, `published-online`: {_DATE_PARTS}, created: {_DATE_PARTS}, DOI: string, author: array<struct<given: string, family: string>>, `container-title`: array<string>, URL: string, type: string, `is-referenced-by-count`: bigint, subject: array<string>>"
SEMANTIC_ITEM = "struct<paperId: string, externalIds: struct<DOI: string, ArXiv: string>, url: string, title: string, abstract: string, venue: string, journal: struct<name: string>, year: int, authors: array<struct<name: string>>, citationCount: bigint, publicationDate: string, publicationTypes: array<string>, openAccessPdf: struct<url: string>, fieldsOfStudy: array<string>, s2FieldsOfStudy: array<struct<category: string>>>"
OPENALEX_WORK = "struct<doi: string, abstract_inverted_index: map<string, array<int>>, primary_topic: struct<display_name: string, subfield: struct<display_name: string>, field: struct<display_name: string>>, topics: array<struct<display_name: string>>>"


def _first_parts(*dates: Column) -> Column:
    """The date parts of the first date that has any."""
    out = F.array().cast("array<int>")
    for d in reversed(dates):
        parts = F.get(d["date-parts"], 0)
        out = F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, parts).otherwise(out)
    return out


def crossref_records(items: DataFrame, item: str = "item", venue: str = "venue") -> DataFrame:
    """Records of Crossref items; titles that are empty or of notices are left out.

    `item` is the item's JSON text, `venue` a struct with journal, venue and pool;
    all other columns stay.
    """
    keep = [c for c in items.columns if c not in (item, venue)]
    x = items.select(*keep, F.from_json(item, CROSSREF_ITEM).alias("i"), F.col(venue).alias("v"))
    i, v = F.col("i"), F.col("v")
    title = F.trim(html_unescape(text_or_empty(F.get(i["title"], 0))))
    source = first_filled(v["journal"], v["venue"])
    parts = _first_parts(i["published-print"], i["published-online"], i["created"])
    container = html_unescape(F.coalesce(F.get(i["container-title"], 0), source))
    names = F.transform(F.coalesce(i["author"], F.array()), lambda a: F.trim(F.concat_ws(" ", text_or_empty(a["given"]), text_or_empty(a["family"]))))
    doi = normalize_doi(i["DOI"])
    out = x.withColumns({"title": title, "journal": container, "parts": parts, "doi": doi})
    return out.filter(is_research_title("title")).select(
        *keep,
        "title",
        strip_abstract_label(strip_markup(i["abstract"])).alias("abstract"),
        partial_date(F.col("parts")).alias("publication_date"),
        F.get("parts", 0).alias("year"),
        F.col("journal").alias("venue"),
        "journal",
        source.alias("journal_source"),
        text_or_empty(v["pool"]).alias("pool"),
        author_list(names).alias("authors"),
        "doi",
        F.col("doi").alias("doi_raw"),
        doi_url("doi").alias("doi_url"),
        text_or_empty(i["URL"]).alias("crossref_url"),
        text_or_empty(i["type"]).alias("type"),
        F.coalesce(i["is-referenced-by-count"], F.lit(0)).alias("citation_count"),
        F.coalesce(i["subject"], F.array().cast("array<string>")).alias("subject"),
        F.lit("crossref").alias("source"),
        F.when(text_or_empty(i["abstract"]) != "", "crossref").otherwise("").alias("abstract_source"),
    )


def semantic_records(items: DataFrame, item: str = "item", query: str = "query") -> DataFrame:
    """Records of Semantic Scholar items; empty titles are left out."""
    keep = [c for c in items.columns if c not in (item, query)]
    x = items.select(*keep, F.from_json(item, SEMANTIC_ITEM).alias("i"), F.col(query).alias("discovery_query"))
    i = F.col("i")
    names = F.filter(F.transform(F.coalesce(i["authors"], F.array()), lambda a: F.trim(text_or_empty(a["name"]))), lambda n: n != "")
    fields = F.transform(F.coalesce(i["fieldsOfStudy"], F.array().cast("array<string>")), lambda s: F.trim(s))
    more = F.filter(F.transform(F.coalesce(i["s2FieldsOfStudy"], F.array()), lambda s: F.trim(text_or_empty(s["category"]))), lambda s: s != "")
    doi = normalize_doi(i["externalIds"]["DOI"])
    venue = F.trim(first_filled(i["venue"], i["journal"]["name"]))
    out = x.withColumns({"title": F.trim(text_or_empty(i["title"])), "doi": doi, "venue": venue})
    return out.filter("title <> ''").select(
        *keep,
        "title",
        F.trim(text_or_empty(i["abstract"])).alias("abstract"),
        first_filled(i["publicationDate"], i["year"].cast("string")).alias("publication_date"),
        i["year"].alias("year"),
        "venue",
        F.col("venue").alias("journal"),
        F.col("venue").alias("journal_source"),
        F.lit("multi-source-discovery").alias("pool"),
        author_list(names).alias("authors"),
        "doi",
        F.col("doi").alias("doi_raw"),
        doi_url("doi").alias("doi_url"),
        F.coalesce(F.array_join(i["publicationTypes"], "; "), F.lit("")).alias("type"),
        F.coalesce(i["citationCount"], F.lit(0)).alias("citation_count"),
        F.array_distinct(F.concat(fields, more)).alias("subject"),
        F.lit("semantic_scholar").alias("source"),
        F.when(text_or_empty(i["abstract"]) != "", "semantic_scholar").otherwise("").alias("abstract_source"),
        text_or_empty(i["paperId"]).alias("s2_paper_id"),
        text_or_empty(i["url"]).alias("semantic_scholar_url"),
        text_or_empty(i["openAccessPdf"]["url"]).alias("open_access_pdf_url"),
        text_or_empty(i["externalIds"]["ArXiv"]).alias("arxiv_id"),
        "discovery_query",
    )


def openalex_works(works: DataFrame, work: str = "work") -> DataFrame:
    """doi, abstract (rebuilt from its inverted index) and topics of OpenAlex works, for `enrich`."""
    w = F.from_json(work, OPENALEX_WORK)
    x = works.select(w.alias("w"))
    w = F.col("w")
    named = F.filter(F.transform(F.coalesce(w["topics"], F.array()), lambda t: text_or_empty(t["display_name"])), lambda t: t != "")
    return x.select(
        normalize_doi(w["doi"]).alias("doi"),
        from_inverted_index(w["abstract_inverted_index"]).alias("abstract"),
        text_or_empty(w["primary_topic"]["display_name"]).alias("primary_topic"),
        text_or_empty(w["primary_topic"]["subfield"]["display_name"]).alias("topic_subfield"),
        text_or_empty(w["primary_topic"]["field"]["display_name"]).alias("topic_field"),
        named.alias("all_topics"),
    )
