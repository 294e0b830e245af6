"""The library's operators bound to the driver's tables, as named queries with their SQL.

`papers` is a view of documents as records: the whole text is title and abstract,
`source` the venue; DOIs and providers follow from ids.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scratch import scratch_dir, spread
from ..operators import dedupe, judging, ranking, screening, state, stats
from ..operators.bucket_state import BucketState
from ..operators.enrich import enrich
from ..operators.judgment_log import judge_durably
from . import outputs
from ..sources.records import crossref_records, openalex_works, semantic_records
from ..streaming.seen_stream import late_rows, lookback_stream, seen_stream, start_append
from ..streaming.state_stream import lookback_counts, stream_bucket_upserts, stream_upserts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

KEYWORDS = {"core": ["ouble", "edon"], "proxy": ["eaux", "shwh"], "eco": ["sch", "tionth", "licht"]}
EXCLUDED = ["SRC 3", "src-7", "src11"]
CAPS, WEEKLY = {"A": 5, "B": 10, "C": 10}, 25
REFERENCE_DAY = "1998-08-02"

PAPERS = r"""
    papers AS (
      SELECT doc_id AS ord, text AS title, text AS abstract, source AS venue, source AS journal, source AS journal_source, lang AS pool,
             CASE WHEN doc_id % 3 = 0 THEN '' ELSE '10.1000/' || doc_id END AS doi,
             CASE WHEN doc_id % 2 = 0 THEN 'crossref' ELSE 'semantic_scholar' END AS source,
             CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'crossref' ELSE 'semantic_scholar' END AS abstract_source
      FROM documents)"""
HAY = "lower(coalesce(venue, '') || ' ' || coalesce(abstract, '') || ' ')"
TIERED = f"""
    hay AS (SELECT *, {HAY} AS hay FROM papers),
    hits AS (SELECT *, {", ".join(f"list_filter({kws!r}, lambda k: contains(hay, k)) AS {t}_hits" for t, kws in KEYWORDS.items())} FROM hay),
    tiered AS (
      SELECT *, CASE WHEN len(core_hits) > 0 THEN 'core' WHEN len(proxy_hits) > 0 THEN 'proxy' WHEN len(eco_hits) > 0 THEN 'eco' ELSE 'other' END AS keyword_tier,
             core_hits || proxy_hits || eco_hits AS matched_keywords FROM hits)"""
ORDERS = r"""
    judged AS (
      SELECT o_orderkey AS ord, CASE left(o_orderpriority, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' WHEN '4' THEN 'D' ELSE 'Ignore' END AS priority,
             CAST(floor(o_totalprice / 1000) AS BIGINT) AS relevance_score, o_totalprice AS semantic_score, strftime(o_orderdate, '%Y-%m-%d') AS publication_date
      FROM orders)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    provider = F.when(even, "crossref").otherwise("semantic_scholar")
    return spread(read(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("ord"),
        F.col("text").alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("venue"),
        F.col("source").alias("journal"),
        F.col("source").alias("journal_source"),
        F.col("lang").alias("pool"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("10.1000/"), F.col("doc_id"))).alias("doi"),
        provider.alias("source"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(provider).alias("abstract_source"),
    )


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.with_keyword_tier(papers(spark, sf_dir), KEYWORDS, title="venue")


def judged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judged records: the priority digit, the price as relevance."""
    digit = F.substring("o_orderpriority", 1, 1)
    priority = F.lit("Ignore")
    for d, p in (("4", "D"), ("3", "C"), ("2", "B"), ("1", "A")):
        priority = F.when(digit == d, p).otherwise(priority)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        priority.alias("priority"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("relevance_score"),
        F.col("o_totalprice").alias("semantic_score"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
    )


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Scalar functions


@query(rf"""WITH {PAPERS} SELECT ord, CASE WHEN doi <> '' THEN 'doi:' || lower(trim(doi))
    ELSE 'title:' || sha256(trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))) END AS stable_id FROM papers""")
def q_stable_id(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", X.stable_id("doi", "title").alias("stable_id"))


@query(rf"""WITH {PAPERS}, s AS (SELECT ord, left(lower(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g')), 80) AS slug FROM papers)
    SELECT ord, CASE WHEN slug = '' THEN 'item' ELSE slug END AS slug FROM s""")
def q_slugify(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", X.slugify("title").alias("slug"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'),
    '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g')) AS text FROM pages""")
def q_strip_markup(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.strip_markup("html", X.basic_unescape).alias("text"))


@query("""SELECT doc_id, '10.1000/abc.' || doc_id AS doi, 'https://doi.org/10.1000/abc.' || doc_id AS doi_url FROM documents""")
def q_normalize_doi(spark, sf_dir):
    forms = F.when(F.col("doc_id") % 3 == 0, F.lit(" https://doi.org/10.1000/ABC.")).when(F.col("doc_id") % 3 == 1, F.lit("http://dx.doi.org/10.1000/abc.")).otherwise(F.lit("10.1000/Abc."))
    doi = X.normalize_doi(F.concat(forms, F.col("doc_id").cast("string"), F.lit(" ")))
    return read(spark, sf_dir, "documents").select("doc_id", doi.alias("doi"), X.doi_url(doi).alias("doi_url"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS partial,
    CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-01' END AS whole FROM orders""")
def q_partial_date(spark, sf_dir):
    d = F.col("o_orderdate")
    parts = F.slice(F.array(F.year(d), F.month(d), F.dayofmonth(d)), 1, (3 - F.col("o_orderkey") % 3).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", X.partial_date(parts).alias("partial"))
    return rows.select("o_orderkey", "partial", F.date_format(X.whole_date(F.col("partial")), "yyyy-MM-dd").alias("whole"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%B %Y') || ' Issue ' || CAST((day(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS label FROM orders""")
def q_issue_label(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", X.issue_label(F.col("o_orderdate")).alias("label"))


@query(r"""SELECT item_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS rebuilt FROM benchmark""")
def q_inverted_index(spark, sf_dir):
    words = F.array_remove(F.split("text", r"[ \t\n\r]+"), "")
    indexed = X.with_inverted_index(read(spark, sf_dir, "benchmark"), ["item_id"], words)
    return indexed.select("item_id", X.from_inverted_index(F.col("index")).alias("rebuilt"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS text FROM documents""")
def q_unescape(spark, sf_dir):
    """Texts written with character references (numbers and all names) and tags, and read again."""
    escaped = F.concat(F.lit("<p>"), F.replace(F.replace(X.escape_html("text"), F.lit("é"), F.lit("&eacute;")), F.lit("r"), F.lit("&#x72;")), F.lit("</p>"))
    return read(spark, sf_dir, "documents").select("doc_id", X.strip_markup(escaped).alias("text"))


_TERMS = {"the entire": "T1", "tion": "T2", "que": "T3"}


@query("""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?i)the entire', '__TERM_0__', 'g'), '(?i)tion', '__TERM_1__', 'g'), '(?i)que', '__TERM_2__', 'g') AS protected FROM conversations""")
def q_glossary_protect(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.protect_terms("text", _TERMS).alias("protected"))


@query("""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?i)the entire', 'T1', 'g'), '(?i)tion', 'T2', 'g'), '(?i)que', 'T3', 'g') AS restored FROM conversations""")
def q_glossary_restore(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", X.protect_terms("text", _TERMS).alias("p"))
    return rows.select("conv_id", "turn", X.restore_terms("p", _TERMS).alias("restored"))


@query("""WITH g AS (SELECT conv_id, list(role || '-' || turn ORDER BY turn, role) AS names FROM conversations GROUP BY conv_id)
    SELECT conv_id, array_to_string(names[1:2], '; ') || CASE WHEN len(names) > 2 THEN ' et al.' ELSE '' END AS authors FROM g""")
def q_author_concat(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    names = F.transform("t", lambda t: F.concat_ws("-", t["role"], t["turn"]))
    return turns.select("conv_id", X.author_list(names, 2).alias("authors"))


@query("""SELECT n_nationkey, CASE r_name WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' ELSE r_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_label_lookup(spark, sf_dir):
    labels = F.create_map(*[F.lit(x) for x in ("ASIA", "Asia", "EUROPE", "Europe")])
    # region is a dimension of fixed size; Spark broadcasts it by its statistics
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.coalesce(F.try_element_at(labels, F.col("r_name")), "r_name").alias("label"))


@query(r"""SELECT doc_id, regexp_matches(text, '\b(?:sk-|s2k-|ghp_|github_pat_)[A-Za-z0-9_-]{20,}') OR contains(text, 'token = "') AS flagged FROM documents""")
def q_secret_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.holds_secret("text", ['token = "']).alias("flagged"))


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') AND p_size >= 10""")
def q_search_filter(spark, sf_dir):
    hit = F.contains(X.search_text("p_name", "p_brand", "p_type"), F.lit("brand#1"))
    return read(spark, sf_dir, "part").filter(hit & (F.col("p_size") >= 10)).select("p_partkey")


@query(rf"""WITH {PAPERS}, e AS (SELECT ord, title,
    replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
    replace(replace(title, '"', ''''), chr(10), ' ') AS yaml, replace(replace(title, '|', '\|'), chr(10), ' ') AS cell, replace(title, '<', '\u003c') AS script FROM papers)
    SELECT ord, html, yaml, cell, script FROM e""")
def q_escape_cells(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", X.escape_html("title").alias("html"), X.escape_yaml("title").alias("yaml"), X.escape_table("title").alias("cell"), X.escape_script("title").alias("script"))


@query("""SELECT c_custkey, 'https://api.example.com/v' || c_nationkey AS base, 'https://api.example.com/v' || c_nationkey || '/embeddings' AS endpoint FROM customer""")
def q_api_base(spark, sf_dir):
    root = F.concat(F.lit("https://api.example.com/v"), F.col("c_nationkey"))
    k = F.col("c_custkey") % 4
    url = F.when(k == 0, root).when(k == 1, F.concat(root, F.lit("/chat/completions"))).when(k == 2, F.concat(root, F.lit("/embeddings/"))).otherwise(F.concat(F.lit("[api]("), root, F.lit(")")))
    return read(spark, sf_dir, "customer").select("c_custkey", X.api_base(url).alias("base"), X.api_endpoint(url, "embeddings").alias("endpoint"))


@query(rf"""WITH {PAPERS} SELECT ord, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi WHEN ord % 2 = 0 THEN 'https://s2.example/' || ord ELSE '' END AS link FROM papers""")
def q_paper_link(spark, sf_dir):
    other = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://s2.example/"), F.col("ord"))).otherwise("")
    return papers(spark, sf_dir).select("ord", X.paper_link(F.col("doi"), other, F.lit("")).alias("link"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(CAST(encode(text) AS BLOB)) AS BIGINT) AS bytes FROM documents")
def q_manifest_sha(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query(rf"""WITH {PAPERS} SELECT ord, sha256('abstract=:' || replace(replace(abstract, '\', '\\'), '|', '\|') || '|doi=:' || doi || '|model=null') AS context_hash FROM papers""")
def q_context_hash(spark, sf_dir):
    inputs = {"abstract": F.col("abstract"), "doi": F.col("doi"), "model": F.lit(None).cast("string")}
    return papers(spark, sf_dir).select("ord", judging.context_hash(inputs).alias("context_hash"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def q_json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# Sources


@query(rf"""WITH {PAPERS} SELECT ord, trim(regexp_replace(title, '[\n\r]+', ' ', 'g')) AS title, trim(regexp_replace(abstract, '[\s\x{{00A0}}]+', ' ', 'g')) AS abstract,
    CASE ord % 3 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '2024-02' ELSE '2024' END AS publication_date, CAST(2024 AS INTEGER) AS year, venue AS journal, pool,
    CASE WHEN ord % 2 = 0 THEN 'G F' ELSE 'G F; A; B; C; D; E; F; H et al.' END AS authors, lower(doi) AS doi
    FROM papers WHERE trim(title) <> '' AND ord % 7 <> 0""")
def q_crossref_normalize(spark, sf_dir):
    p = papers(spark, sf_dir).filter("trim(title) <> ''")
    whole = F.array(F.lit(2024), F.lit(2), F.lit(3))
    few = [F.struct(F.lit("G").alias("given"), F.lit("F").alias("family"))]
    many = few + [F.struct(F.lit("").alias("given"), F.lit(c).alias("family")) for c in "ABCDEFHI"]
    title = F.when(F.col("ord") % 7 == 0, F.lit("Erratum: a note")).otherwise(F.trim(F.regexp_replace("title", r"[\n\r]+", " ")))
    item = F.to_json(
        F.struct(
            F.array(F.replace(title, F.lit("&"), F.lit("&amp;"))).alias("title"),
            F.concat(F.lit("<p>Abstract. <b>"), X.escape_html("abstract"), F.lit("</b> </p>")).alias("abstract"),
            F.struct(F.array(F.slice(whole, 1, (3 - F.col("ord") % 3).cast("int"))).alias("date-parts")).alias("published-online"),
            F.upper("doi").alias("DOI"),
            F.when(F.col("ord") % 2 == 0, F.array(*few)).otherwise(F.array(*many)).alias("author"),
            F.array("venue").alias("container-title"),
        )
    )
    venue = F.struct(F.lit("x").alias("journal"), F.lit("").alias("venue"), F.col("pool").alias("pool"))
    rows = crossref_records(p.select("ord", item.alias("item"), venue.alias("venue")))
    return rows.select("ord", "title", "abstract", "publication_date", "year", "journal", "pool", "authors", "doi")


@query(rf"""WITH {PAPERS} SELECT ord, trim(title) AS title, '2024' AS publication_date, venue, lower(doi) AS doi, 'a1; a2' AS authors, 'en;X;Y' AS subjects, 'q' AS discovery_query
    FROM papers WHERE trim(title) <> ''""")
def q_semantic_normalize(spark, sf_dir):
    item = F.to_json(
        F.struct(
            F.col("title"),
            F.struct(F.upper("doi").alias("DOI")).alias("externalIds"),
            F.col("venue"),
            F.lit(2024).alias("year"),
            F.array(*[F.struct(F.lit(n).alias("name")) for n in ("a1", " ", "a2 ")]).alias("authors"),
            F.array(F.lit("en"), F.lit("X ")).alias("fieldsOfStudy"),
            F.array(*[F.struct(F.lit(n).alias("category")) for n in ("X", "Y", "")]).alias("s2FieldsOfStudy"),
        )
    )
    rows = semantic_records(papers(spark, sf_dir).select("ord", item.alias("item"), F.lit("q").alias("query")))
    return rows.select("ord", "title", "publication_date", "venue", "doi", "authors", F.array_join("subject", ";").alias("subjects"), "discovery_query")


@query(r"""SELECT i.item_id, CASE WHEN i.item_id % 2 = 0 THEN 'own' ELSE trim(regexp_replace(i.text, '[ \t\n\r]+', ' ', 'g')) END AS abstract,
    CASE WHEN i.item_id % 2 = 0 THEN 'crossref' ELSE 'openalex' END AS abstract_source, 'topic' AS primary_topic FROM benchmark i""")
def q_openalex_enrich(spark, sf_dir):
    words = F.array_remove(F.split("text", r"[ \t\n\r]+"), "")
    items = read(spark, sf_dir, "benchmark")
    indexed = X.with_inverted_index(items, ["item_id"], words)
    doi = F.concat(F.lit("10.1000/b."), F.col("item_id"))
    work = F.to_json(F.struct(F.concat(F.lit("https://doi.org/"), doi).alias("doi"), F.col("index").alias("abstract_inverted_index"), F.struct(F.lit("topic").alias("display_name")).alias("primary_topic")))
    own = F.col("item_id") % 2 == 0
    left = items.select("item_id", F.col("item_id").alias("ord"), doi.alias("doi_raw"), F.when(own, "own").otherwise("").alias("abstract"), F.when(own, "crossref").otherwise("").alias("abstract_source"))
    return enrich(left, openalex_works(indexed.select(work.alias("work")))).select("item_id", "abstract", "abstract_source", "primary_topic")


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5""")
def q_per_query_cap(spark, sf_dir):
    return ranking.top_per_group(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 5).select("event_id", "user_id")


@query("""SELECT 'customer' AS kind, c_name AS name, c_nationkey AS nation, NULL AS segment FROM customer WHERE FALSE
    UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL FROM supplier UNION ALL SELECT 'customer', c_name, c_nationkey, c_mktsegment FROM customer""")
def q_union_sources(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    b = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-16'""")
def q_date_window(spark, sf_dir):
    start, end = ranking.window_bounds(None, "2024-01-15", 7, "2024-01-15")
    day = F.col("ts")
    return read(spark, sf_dir, "events").filter((day >= F.lit(start).cast("timestamp")) & (day < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))).select("event_id")


# Deduplication


@query(rf"""WITH {PAPERS}, k AS (SELECT ord, title, CASE WHEN doi <> '' AND ord % 2 = 0 THEN 'd:' || doi ELSE 't:' || regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]+', '', 'g') END AS key FROM papers)
    SELECT ord, title FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM k) WHERE n = 1""")
def q_dedupe_first(spark, sf_dir):
    doi = F.when(F.col("ord") % 2 == 0, F.col("doi")).otherwise("")
    return dedupe.first_by_key(papers(spark, sf_dir), dedupe.venue_key(doi, "title")).select("ord", "title")


@query(r"""SELECT doc_id AS ord FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE md5(text) END AS doi FROM documents)
    WHERE doi = '' OR doc_id IN (SELECT min(doc_id) FROM documents WHERE doc_id % 3 <> 0 GROUP BY md5(text))""")
def q_dedupe_doi_only(spark, sf_dir):
    doi = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.md5("text"))
    return dedupe.first_by_doi(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), doi.alias("doi"))).select("ord")


@query(rf"""WITH {PAPERS}, k AS (SELECT *, 'title:' || sha256(trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))) AS stable_id FROM papers),
    w AS (SELECT stable_id, min(ord) AS ord, first(ord ORDER BY length(abstract) DESC, ord) AS at, first(abstract ORDER BY length(abstract) DESC, ord) AS abstract,
            first(abstract_source ORDER BY length(abstract) DESC, ord) AS won_source, first(pool ORDER BY ord) FILTER (pool <> '') AS pool,
            coalesce(first(doi ORDER BY ord) FILTER (doi <> ''), '') AS doi, first(venue ORDER BY ord) FILTER (venue <> '') AS venue FROM k GROUP BY stable_id),
    l AS (SELECT k.stable_id, first(k.abstract_source ORDER BY k.ord) AS later FROM k JOIN w USING (stable_id) WHERE k.ord > w.at AND k.abstract_source <> '' GROUP BY k.stable_id),
    s AS (SELECT stable_id, string_agg(source, ';' ORDER BY f) AS source FROM (SELECT stable_id, source, min(ord) AS f FROM k GROUP BY stable_id, source) GROUP BY stable_id)
    SELECT stable_id, ord, sha256(abstract) AS abstract, CASE WHEN won_source <> '' THEN won_source ELSE coalesce(later, '') END AS abstract_source, pool, doi, venue, source
    FROM w JOIN s USING (stable_id) LEFT JOIN l USING (stable_id)""")
def q_merge_sources(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("stable_id", X.stable_id(F.lit(""), "title"))
    merged = dedupe.merge_records(p.select("stable_id", "ord", "pool", "abstract", "abstract_source", "doi", "venue", "source"))
    return merged.select("stable_id", "ord", F.sha2("abstract", 256).alias("abstract"), "abstract_source", "pool", "doi", "venue", "source")


@query("""SELECT user_id, string_agg(event_type, '; ' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id""")
def q_ordered_distinct(spark, sf_dir):
    rows = dedupe.ordered_distinct(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "types")
    return rows.select("user_id", X.joined_list(F.col("types")).alias("types"))


@query("""SELECT DISTINCT source AS value FROM documents WHERE source <> ''""")
def q_distinct_values(spark, sf_dir):
    return stats.distinct_values(read(spark, sf_dir, "documents"), "source").withColumnRenamed("source", "value")


# Screening


@query("""SELECT doc_id AS ord FROM documents WHERE source NOT IN ('src3', 'src7', 'src11')""")
def q_exclude_journal(spark, sf_dir):
    return papers(spark, sf_dir).filter(~screening.is_excluded(EXCLUDED, doi=("doi",))).select("ord")


@query("""SELECT count(*) FILTER (source IN ('src3', 'src7', 'src11')) AS excluded, count(*) AS scanned FROM documents""")
def q_excluded_count(spark, sf_dir):
    return papers(spark, sf_dir).agg(F.count_if(screening.is_excluded(EXCLUDED, doi=("doi",))).alias("excluded"), F.count("*").alias("scanned"))


@query("""SELECT doc_id FROM documents WHERE trim(text) <> '' AND doc_id % 4 <> 0""")
def q_nonresearch_drop(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("Author Correction "), "text")).when(F.col("doc_id") % 4 == 0, F.concat(F.lit("News & Views: "), "text")).otherwise(F.trim("text"))
    return d.filter(screening.is_research_title(title)).select("doc_id")


@query("""SELECT doc_id, contains(source, 'src1') AS matched FROM documents""")
def q_alias_match(spark, sf_dir):
    aliases = F.array(F.lit("SRC1"), F.lit("rc2"))  # the second is too short to count
    return read(spark, sf_dir, "documents").select("doc_id", screening.matches_alias("source", aliases).alias("matched"))


@query(f"""WITH {PAPERS}, {TIERED} SELECT ord, array_to_string(core_hits, ';') AS core, array_to_string(proxy_hits, ';') AS proxy, array_to_string(eco_hits, ';') AS eco FROM tiered""")
def q_keyword_hits(spark, sf_dir):
    return tiered(spark, sf_dir).select("ord", *[F.array_join(f"{t}_hits", ";").alias(t) for t in screening.TIERS])


@query(f"""WITH {PAPERS}, {TIERED} SELECT ord, keyword_tier, array_to_string(matched_keywords, ';') AS matched FROM tiered""")
def q_keyword_tier(spark, sf_dir):
    return tiered(spark, sf_dir).select("ord", "keyword_tier", F.array_join("matched_keywords", ";").alias("matched"))


@query(f"""WITH {PAPERS}, {TIERED} SELECT keyword_tier, count(*) AS n FROM tiered GROUP BY keyword_tier""")
def q_tier_histogram(spark, sf_dir):
    return screening.tier_histogram(tiered(spark, sf_dir))


@query(f"""WITH {PAPERS}, {TIERED} SELECT pool, keyword_tier, count(*) AS n, CAST(GROUPING(pool, keyword_tier) AS INTEGER) AS level FROM tiered GROUP BY ROLLUP (pool, keyword_tier)""")
def q_tier_totals(spark, sf_dir):
    return screening.tier_totals(tiered(spark, sf_dir), "pool")


@query(r"""WITH words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark)),
    hits AS (SELECT doc_id, w FROM documents JOIN words ON contains(lower(text), w))
    SELECT d.doc_id, count(w) AS n, md5(coalesce(string_agg(w, ' ' ORDER BY w), '')) AS hits FROM documents d LEFT JOIN hits ON hits.doc_id = d.doc_id GROUP BY d.doc_id""")
def q_keyword_many(spark, sf_dir):
    """A vocabulary of thousands: all longer words of the benchmark, anywhere in the documents."""
    found = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct()
    vocabulary = sorted(r.w for r in found.collect())
    docs = spread(read(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("title"), F.lit("").alias("abstract"))
    hits = screening.with_keyword_tier(docs, {"core": vocabulary})
    return hits.select("doc_id", F.size("core_hits").cast("long").alias("n"), F.md5(F.array_join("core_hits", " ").cast("binary")).alias("hits"))


@query(f"""WITH {PAPERS}, k(tier, keyword) AS (VALUES {", ".join(f"('{t}', '{k}')" for t, ks in KEYWORDS.items() for k in ks)}), hay AS (SELECT ord, {HAY} AS hay FROM papers)
    SELECT ord, tier, keyword FROM hay JOIN k ON contains(hay, keyword)""")
def q_keyword_long(spark, sf_dir):
    return screening.keyword_pairs(papers(spark, sf_dir), KEYWORDS, "ord", title="venue").select("ord", "tier", "keyword")


_SCORES = """
    q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
    scores AS (SELECT vec_id, round(least(1.0, greatest(0.0, list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
        / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))))), 6) AS semantic_score
        FROM embeddings, q)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    one = e.filter("vec_id = 0").select("embedding").first()  # the query is one vector
    vector = F.array(*[F.lit(float(x)) for x in one[0]]) if one else F.array().cast("array<double>")
    return ranking.with_cosine(e, vector)


@query(f"""WITH {_SCORES} SELECT vec_id, semantic_score, CAST(row_number() OVER (ORDER BY semantic_score DESC, vec_id) AS INTEGER) AS semantic_rank FROM scores""")
def q_cosine_rank(spark, sf_dir):
    return ranking.with_semantic_rank(_scored(spark, sf_dir), "vec_id").select("vec_id", "semantic_score", "semantic_rank")


@query(f"""WITH {PAPERS}, {TIERED}, {_SCORES} SELECT ord FROM tiered LEFT JOIN scores ON ord = vec_id WHERE keyword_tier <> 'other' OR coalesce(semantic_score, 0) >= 0.15""")
def q_candidate_filter(spark, sf_dir):
    scores = _scored(spark, sf_dir).select(F.col("vec_id").alias("ord"), "semantic_score")
    joined = tiered(spark, sf_dir).select("ord", "keyword_tier").join(scores, "ord", "left")
    return joined.filter(screening.is_candidate(True, 0.15)).select("ord")


# Judging


@query(f"""WITH {PAPERS}, {TIERED} SELECT ord, CAST(CASE keyword_tier WHEN 'core' THEN 85 WHEN 'proxy' THEN 65 WHEN 'eco' THEN 45 ELSE 0 END AS INTEGER) AS relevance_score,
    CASE keyword_tier WHEN 'core' THEN 'A' WHEN 'proxy' THEN 'B' WHEN 'eco' THEN 'C' ELSE 'Ignore' END AS priority, keyword_tier AS research_track,
    CASE keyword_tier WHEN 'core' THEN 'deep-read' WHEN 'proxy' THEN 'skim' WHEN 'eco' THEN 'save' ELSE 'ignore' END AS recommended_action,
    array_to_string(matched_keywords, ';') AS topics, CASE WHEN keyword_tier <> 'other' THEN '{judging.FALLBACK_REASON}' ELSE '' END AS why_relevant FROM tiered""")
def q_fallback_judgment(spark, sf_dir):
    j = judging.fallback(F.col("keyword_tier"), F.col("matched_keywords"))
    rows = tiered(spark, sf_dir).select("ord", j.alias("j"))
    return rows.select("ord", *[f"j.{f}" for f in ("relevance_score", "priority", "research_track", "recommended_action")], F.array_join("j.matched_topics", ";").alias("topics"), "j.why_relevant")


_RAW = """CASE WHEN doc_id % 9 = 8 THEN 'no object here' ELSE
      CASE WHEN doc_id % 2 = 0 THEN '```json' || chr(10) ELSE '' END || '{"relevance_score": ' || CASE doc_id % 9 WHEN 1 THEN 'true' WHEN 2 THEN '90.5' WHEN 3 THEN '101' WHEN 4 THEN '10' ELSE '90' END ||
      ', "research_track": "t", "priority": "' || CASE WHEN doc_id % 9 = 5 THEN 'urgent' ELSE 'A' END || '", "matched_topics": ' || CASE WHEN doc_id % 9 = 6 THEN '[3]' ELSE '["x"]' END ||
      ', "research_question": "", "method_summary": "", "main_contributions": [], "why_relevant": "", "methodological_value": "", "potential_use": "", "related_project": ""' ||
      CASE WHEN doc_id % 9 = 7 THEN '' ELSE ', "recommended_action": "deep-read"' END || '}' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '```' ELSE '' END END"""


@query("""SELECT doc_id, doc_id % 9 = 0 AS valid FROM labels""")
def q_judge_validate(spark, sf_dir):
    raw = read(spark, sf_dir, "labels").selectExpr("doc_id", f"{_RAW} AS raw")
    return raw.select("doc_id", judging.valid_judgment(F.col("raw"), []).alias("valid"))


@query("""SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1""")
def q_judgment_reuse(spark, sf_dir):
    return _reuse(spark, sf_dir)[0].select("doc_id", "quality", "toxic")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def q_judgment_todo(spark, sf_dir):
    return _reuse(spark, sf_dir)[1].select("doc_id")


def _reuse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    done = read(spark, sf_dir, "labels").withColumn("status", F.when(F.col("quality") == 1, "complete").otherwise("failed"))
    return judging.reuse(read(spark, sf_dir, "documents"), done, ["doc_id"])


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN d.source WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality ELSE '' END AS note FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_enrich_left_join(spark, sf_dir):
    doi = F.concat(F.lit("10.1000/"), F.col("doc_id"))
    left = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ord"), doi.alias("doi_raw"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise("").alias("abstract"), F.lit("").alias("abstract_source"))
    none = F.lit("")
    works = read(spark, sf_dir, "labels").select(doi.alias("doi"), F.concat(F.lit("quality "), F.col("quality")).alias("abstract"), *[none.alias(c) for c in ("primary_topic", "topic_subfield", "topic_field")], F.array(none).alias("all_topics"))
    return enrich(left, works).select("doc_id", F.col("abstract").alias("note"))


# Ranking and counts


@query(f"""WITH {ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY relevance_score DESC, semantic_score DESC, ord) AS n FROM judged WHERE priority IN ('A', 'B', 'C'))
    SELECT ord, priority, relevance_score FROM (SELECT * FROM r WHERE n <= CASE priority WHEN 'A' THEN 5 ELSE 10 END ORDER BY priority, relevance_score DESC, semantic_score DESC, ord LIMIT 25)""")
def q_capacity_topk(spark, sf_dir):
    return ranking.select_capacity(judged_orders(spark, sf_dir), CAPS, WEEKLY).select("ord", "priority", "relevance_score")


@query(f"""WITH {ORDERS} SELECT ord, row_number() OVER (ORDER BY CASE priority WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 ELSE 4 END, relevance_score DESC, publication_date, ord) AS place FROM judged""")
def q_report_order(spark, sf_dir):
    rows = judged_orders(spark, sf_dir).withColumns({"rank": ranking.priority_rank(F.col("priority")), "less": -F.col("relevance_score")})
    placed = ranking.with_positions(rows, ["rank", "less", "publication_date", "ord"], name="report-order")
    return placed.select("ord", (F.col("row_pos") + 1).alias("place"))


_COUNTS = ", ".join(f"count(*) FILTER (priority = '{p}') AS count_{p.lower()}" for p in ranking.PRIORITIES)


@query(f"""WITH {ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY relevance_score DESC, semantic_score DESC, ord) AS n FROM judged),
    picked AS (SELECT * FROM r WHERE n <= CASE priority WHEN 'A' THEN 5 WHEN 'B' THEN 10 WHEN 'C' THEN 10 ELSE 0 END) SELECT {_COUNTS} FROM picked""")
def q_priority_stats(spark, sf_dir):
    return stats.priority_stats(ranking.select_capacity(judged_orders(spark, sf_dir), CAPS, WEEKLY))


@query(f"""WITH {ORDERS} SELECT {_COUNTS} FROM judged""")
def q_judged_stats(spark, sf_dir):
    return stats.priority_stats(judged_orders(spark, sf_dir))


@query(f"""WITH {ORDERS} SELECT count(*) AS scanned, count(*) FILTER (priority <> 'Ignore') AS candidates, {_COUNTS} FROM judged""")
def q_run_ledger(spark, sf_dir):
    df = judged_orders(spark, sf_dir)
    return stats.priority_stats(df, F.count("*").alias("scanned"), F.count_if(F.col("priority") != "Ignore").alias("candidates"))


@query(f"""WITH {ORDERS} SELECT ord FROM judged WHERE CAST(publication_date AS DATE) BETWEEN DATE '{REFERENCE_DAY}' - 30 AND DATE '{REFERENCE_DAY}'""")
def q_report_days_filter(spark, sf_dir):
    df = judged_orders(spark, sf_dir)
    return df.filter(ranking.within_days(F.col("publication_date"), F.lit(REFERENCE_DAY).cast("date"), 30)).select("ord")


@query("""SELECT CAST(least(55, greatest(12, greatest(max(length(p_name)), 6) + 2)) AS INTEGER) AS p_name, CAST(least(55, greatest(12, greatest(max(length(p_type)), 6) + 2)) AS INTEGER) AS p_type FROM part""")
def q_column_width(spark, sf_dir):
    return stats.column_widths(read(spark, sf_dir, "part"), ["p_name", "p_type"])


# State

_STATE = """
    old AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, event_id) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-10' AND user_id % 3 <> 0 GROUP BY user_id),
    new AS (SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, arg_max(event_type, event_id) AS event_type FROM events WHERE NOT (ts < TIMESTAMP '2024-01-10' AND user_id % 3 <> 0) GROUP BY user_id),
    up AS (SELECT coalesce(old.user_id, new.user_id) AS user_id, coalesce(new.event_type, old.event_type) AS event_type, coalesce(old.first_seen, new.first_at) AS first_seen,
      coalesce(new.last_at, old.last_seen) AS last_seen, CASE WHEN old.user_id IS NULL THEN 'new' ELSE 'saved' END AS reading_status, old.user_id IS NULL AS is_new, new.user_id IS NOT NULL AS in_batch
      FROM old FULL OUTER JOIN new ON old.user_id = new.user_id)"""


def _state_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events")
    early = (F.col("ts") < F.lit("2024-01-10").cast("timestamp")) & (F.col("user_id") % 3 != 0)
    old = events.filter(early).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.lit("saved").alias("reading_status"))
    return old, events.filter(~early).select("user_id", "event_type", F.col("ts").alias("seen_at"), F.col("event_id").alias("ord"))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert(*_state_and_batch(spark, sf_dir), ["user_id"], ["event_type"], {"reading_status": F.lit("new")})


@query(f"""WITH {_STATE} SELECT user_id, event_type, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, reading_status, is_new FROM up""")
def q_upsert_state(spark, sf_dir):
    return _upserted(spark, sf_dir).select("user_id", "event_type", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")], "reading_status", "is_new")


@query(f"""WITH {_STATE} SELECT user_id, event_type, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, reading_status, is_new FROM up""")
def q_upsert_buckets(spark, sf_dir):
    """The same state in hash buckets, of which the batch writes the changed rows alone."""
    old, batch = _state_and_batch(spark, sf_dir)
    schema = "user_id long, event_type string, first_seen timestamp, last_seen timestamp, reading_status string"
    table = BucketState(spark, f"{scratch_dir(spark)}/buckets-{uuid.uuid4().hex}", schema, ("user_id",), 16)
    table.add(old)
    changed = table.upsert(batch, ["event_type"], {"reading_status": F.lit("new")})
    rows = table.read().join(changed.select("user_id", "is_new"), "user_id", "left")
    return rows.select("user_id", "event_type", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")], "reading_status", F.coalesce("is_new", F.lit(False)).alias("is_new"))


@query(f"""WITH {_STATE} SELECT is_new, count(*) AS n FROM up WHERE in_batch GROUP BY is_new""")
def q_new_vs_seen(spark, sf_dir):
    return _upserted(spark, sf_dir).filter("in_batch").groupBy("is_new").agg(F.count("*").alias("n"))


def _feedback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "read").when(F.col("event_type") == "error", "broken").otherwise("")
    none = F.lit(None).cast("string")
    records = events.select(F.col("event_id").alias("ord"), (F.col("event_id") % 7).cast("string").alias("rating"), none.alias("reading_status"), action.alias("action"), F.col("user_id").alias("paper_id"), none.alias("stable_id"))
    papers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), "c_custkey").alias("stable_id"))
    return state.resolve_feedback(records, papers)


_FEEDBACK = """
    f AS (SELECT event_id, event_id % 7 AS rating, CASE event_type WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'broken' ELSE 'saved' END AS status, user_id IN (SELECT c_custkey FROM customer) AS found, user_id FROM events),
    r AS (SELECT *, CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating must be 1..5' WHEN status = 'broken' THEN 'invalid reading_status: broken' WHEN NOT found THEN 'paper not found' END AS reason FROM f)"""


@query(f"""WITH {_FEEDBACK} SELECT event_id AS ord, CAST(rating AS INTEGER) AS rating, status, user_id AS resolved_id FROM r WHERE reason IS NULL""")
def q_feedback_validate(spark, sf_dir):
    return _feedback(spark, sf_dir)[0].select("ord", F.col("rating_value").alias("rating"), "status", "resolved_id")


@query(f"""WITH {_FEEDBACK} SELECT event_id AS ord, 'record ' || event_id || ': ' || reason AS error FROM r WHERE reason IS NOT NULL""")
def q_feedback_errors(spark, sf_dir):
    return _feedback(spark, sf_dir)[1]


_UPDATED = """
    known AS (SELECT user_id, arg_max(event_type, event_id) AS keyword_tier, count(*) AS relevance_score FROM events GROUP BY user_id),
    fresh AS (SELECT user_id, max(event_type) AS keyword_tier, CAST(sum(length(event_type)) AS BIGINT) AS relevance_score FROM events WHERE user_id % 2 = 0 GROUP BY user_id)"""


@query(f"""WITH {_UPDATED} SELECT k.user_id, coalesce(f.keyword_tier, k.keyword_tier) AS keyword_tier, coalesce(f.relevance_score, k.relevance_score) AS relevance_score FROM known k LEFT JOIN fresh f USING (user_id)""")
def q_update_analysis(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    known = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("keyword_tier"), F.count("*").alias("relevance_score"))
    fresh = events.filter("user_id % 2 = 0").groupBy("user_id").agg(F.max("event_type").alias("keyword_tier"), F.sum(F.length("event_type")).cast("long").alias("relevance_score"))
    return state.update_analysis(known, fresh, ["user_id"], ["keyword_tier", "relevance_score"])


@query(f"""WITH {_STATE} SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) AS BIGINT) AS id FROM up""")
def q_state_ids(spark, sf_dir):
    """Numbers of a state's rows, given in two batches: what was numbered keeps its number."""
    rows = _upserted(spark, sf_dir).select("user_id", F.lit(None).cast("long").alias("id"))
    once = state.with_ids(rows, ["user_id"])
    return state.with_ids(once, ["user_id"]).select("user_id", "id")


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'complete' ELSE 'failed' END AS status, CASE WHEN l.quality = 1 THEN 'sound' ELSE '["poor","poor"]' END AS raw_response
    FROM documents d JOIN labels l USING (doc_id)""")
def q_save_judgment(spark, sf_dir):
    """Judgments of labelled documents by a judge that answers soundly for the good ones: two attempts, then all answers."""
    sound = '''{"relevance_score": 90, "research_track": "", "priority": "A", "matched_topics": [], "research_question": "", "method_summary": "", "main_contributions": [], "why_relevant": "", "methodological_value": "", "potential_use": "", "related_project": "", "recommended_action": "save"}'''
    todo = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality")
    # the prompt tells which; what a judge would make of the text does not matter here
    judged = judging.judge_todo(todo, lambda asked: asked.map(lambda c: sound if "good" in c.split("}")[0] else "poor"), F.when(F.col("quality") == 1, "good").otherwise("bad"), [])
    return judged.select("doc_id", "status", F.when(F.col("status") == "complete", "sound").otherwise(F.col("raw_response")).alias("raw_response"))


@query("""SELECT d.doc_id, 'complete' AS status, CASE WHEN l.quality = 1 THEN 'reused' ELSE 'completed' END AS judge_checkpoint, CASE WHEN l.quality = 1 THEN 'first' ELSE 'second' END AS research_track
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_judgment_resume(spark, sf_dir):
    """A run that judged the good documents alone, then one over all: what the log holds is not asked about again."""
    folder = f"{scratch_dir(spark)}/judgments-{uuid.uuid4().hex}"

    def judge(track: str):
        answer = json.dumps({f: [] if f in judging.LIST_FIELDS else "" for f in judging.FIELDS} | {"relevance_score": 90, "priority": "A", "recommended_action": "save", "research_track": track})
        return lambda asked: asked.map(lambda _: answer)

    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stable_id"), F.lit("c").alias("context_hash"), F.lit("m").alias("model"), "doc_id")
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    for run, rows in (("first", ids.join(good, "doc_id", "left_semi")), ("second", ids)):
        judged = judge_durably(rows, judge(run), F.col("stable_id"), folder, run, portion=64)
    return judged.select("doc_id", "status", "judge_checkpoint", F.get_json_object("raw_response", "$.research_track").alias("research_track"))


@query("""SELECT o_orderkey AS ord, CASE left(o_orderpriority, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' WHEN '4' THEN 'D' ELSE 'Ignore' END AS priority,
    strftime(o_orderdate, '%Y-%m-%d') AS publication_date FROM orders""")
def q_snapshot(spark, sf_dir):
    """A snapshot as JSON lines, read back."""
    path = outputs.snapshot(judged_orders(spark, sf_dir), f"{scratch_dir(spark)}/snapshot-{uuid.uuid4().hex}", "kg", REFERENCE_DAY, "judged")
    return spark.read.schema("ord long, priority string, publication_date string").json(path)


# Flagship


@query(f"""WITH {PAPERS}, {TIERED}, j AS (SELECT ord, title, CASE keyword_tier WHEN 'core' THEN 'A' WHEN 'proxy' THEN 'B' ELSE 'C' END AS priority, CAST(CASE keyword_tier WHEN 'core' THEN 85 WHEN 'proxy' THEN 65 ELSE 45 END AS INTEGER) AS relevance_score FROM tiered WHERE keyword_tier <> 'other'),
    r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY ord) AS n FROM j)
    SELECT ord, title, priority, relevance_score FROM r WHERE n <= CASE priority WHEN 'A' THEN 5 ELSE 10 END""")
def q_triage_flagship(spark, sf_dir):
    """Keyword tiers, the candidate filter, the fallback judgment and the capacity-limited queue."""
    j = judging.fallback(F.col("keyword_tier"), F.col("matched_keywords"))
    candidates = tiered(spark, sf_dir).filter(screening.is_candidate()).select("ord", "title", j.alias("j"), F.lit(None).cast("double").alias("semantic_score"))
    judged = candidates.select("ord", "title", "semantic_score", "j.priority", "j.relevance_score")
    return ranking.select_capacity(judged, CAPS, WEEKLY).select("ord", "title", "priority", "relevance_score")


# Streaming


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY user_id""")
def q_stream_upserts(spark, sf_dir):
    """The state that a stream of events leaves when its micro-batches upsert it."""
    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select("user_id", "event_type", F.col("ts").alias("seen_at"), F.col("event_id").alias("ord"))
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = "user_id long, event_type string, first_seen timestamp, last_seen timestamp, reading_status string"
    stream_upserts(rows, root, "users", schema, ["user_id"], ["event_type"], {"reading_status": F.lit("new")}, f"{root}/checkpoint").awaitTermination()
    found, _ = state.read_version(spark, root, "users")
    return found.select("user_id", "event_type", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY user_id""")
def q_stream_buckets(spark, sf_dir):
    """The state that two streams after each other leave in one bucketed table, the second with a checkpoint of its own."""
    source = read(spark, sf_dir, "events")
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = BucketState(spark, f"{root}/users", "user_id long, event_type string, first_seen timestamp, last_seen timestamp, reading_status string", ("user_id",), 16)
    for half in (0, 1):
        stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
        # the earlier half of each user's events first
        mine = stream.filter((F.col("ts") < F.lit("2024-01-10").cast("timestamp")) == (half == 0))
        rows = mine.select("user_id", "event_type", F.col("ts").alias("seen_at"), F.col("event_id").alias("ord"))
        stream_bucket_upserts(rows, table, ["event_type"], {"reading_status": F.lit("new")}, f"{root}/checkpoint-{half}").awaitTermination()
    return table.read().select("user_id", "event_type", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])


_SPLIT = "2024-01-20"


def _starts(spark: SparkSession, sf_dir: str, second: Column, plan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list]:
    """(what a stream of events appends, its queries) that starts twice: on the events that are not `second`, then on those too."""
    events, root = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"), f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    started = []
    for part in (~second, second):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        started.append(start_append(plan(stream), f"{root}/out", f"{root}/checkpoint"))
        started[-1].awaitTermination()
    return spark.read.parquet(f"{root}/out"), started


@query(f"""WITH a AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events WHERE ts < TIMESTAMP '{_SPLIT}' GROUP BY user_id), b AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events WHERE ts >= TIMESTAMP '{_SPLIT}' GROUP BY user_id),
    r AS (SELECT *, true AS is_new FROM a UNION ALL SELECT b.user_id, coalesce(a.f, b.f), b.l, a.user_id IS NULL FROM b LEFT JOIN a ON a.user_id = b.user_id)
    SELECT user_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_seen, is_new FROM r""")
def q_stream_seen(spark, sf_dir):
    """Users told apart into new and seen by a stream that stops and starts again."""
    later = F.col("ts") >= F.lit(_SPLIT).cast("timestamp")
    found, _ = _starts(spark, sf_dir, later, lambda s: seen_stream(s, "user_id", "ts"))
    return found.select(F.col("k").cast("long").alias("user_id"), *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")], "is_new")


_LATE = "user_id % 10 = 0 AND ts < TIMESTAMP '2024-01-15'"


@query(f"""WITH m AS (SELECT max(ts) FILTER (ts < TIMESTAMP '{_SPLIT}' AND NOT ({_LATE})) - INTERVAL 1 DAY AS early, max(ts) - INTERVAL 1 DAY AS last FROM events),
    w AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events, m WHERE NOT ({_LATE} AND ts <= early) GROUP BY d, event_type)
    SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n FROM w, m WHERE d + INTERVAL 1 DAY <= last
    UNION ALL SELECT 'late', '', count(*) FILTER ({_LATE} AND ts <= early) FROM events, m""")
def q_stream_lookback(spark, sf_dir):
    """Complete days of a stream that starts twice, and how many of its rows came after the watermark."""
    second = F.expr(f"({_LATE}) OR ts >= TIMESTAMP '{_SPLIT}'")
    found, started = _starts(spark, sf_dir, second, lambda s: lookback_stream(s, "event_id", "ts", "1 day", "1 day", "event_type"))
    late = spark.createDataFrame([("late", "", sum(map(late_rows, started)))], "day string, event_type string, n long")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n").unionByName(late)


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def q_daily_counts(spark, sf_dir):
    """Tumbling one-day windows; the same function counts a stream."""
    counted = lookback_counts(read(spark, sf_dir, "events"), "ts", "1 hour", "1 day", "event_type")
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
