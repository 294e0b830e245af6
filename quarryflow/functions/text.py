"""Column functions for record metadata: identifiers, markup, dates, lists, escapes.

All are built-in expressions, except `html_unescape` and `normalized_name`,
whose full Unicode and entity tables Spark lacks; these are Arrow UDFs.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Anything but letters, digits and underscore, in Unicode's sense.
NON_WORD = r"[^\p{L}\p{N}_]+"

#: The patterns that identifiers, slugs and abstracts are cleaned by, and how access tokens begin.
DOI_RESOLVER = r"^https?://(dx\.)?doi\.org/"
SLUG_BREAK = r"[^a-zA-Z0-9一-鿿]+"
ABSTRACT_LABEL = r"(?i)^abstract\.?\s*"
API_ENDPOINT = r"/(chat/completions|embeddings)$"
SECRET = r"\b(?:sk-|s2k-|ghp_|github_pat_)[A-Za-z0-9_-]{20,}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in xs], F.lit(""))


# Identifiers


def normalize_doi(x: Column | str) -> Column:
    """Trimmed, lower case, without a resolver address in front; a `doi:` prefix stays."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text_or_empty(x))), DOI_RESOLVER, ""))


def doi_url(doi: Column | str) -> Column:
    return F.when(text_or_empty(doi) == "", F.lit("")).otherwise(F.concat(F.lit("https://doi.org/"), _c(doi)))


def title_key(title: Column | str, between: str = " ") -> Column:
    """Lower case, each run of non-word characters as `between`, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(title)), NON_WORD, between))


def stable_id(doi: Column | str, title: Column | str) -> Column:
    """`doi:` and the DOI, else `title:` and the hash of the title's words. All blank rows share an id."""
    key = normalize_doi(doi)
    return F.when(key != "", F.concat(F.lit("doi:"), key)).otherwise(F.concat(F.lit("title:"), F.sha2(title_key(title), 256)))


def slugify(x: Column | str, most: int = 80) -> Column:
    """Runs of other characters as hyphens, none at the ends, lower case, at most `most` characters; `item` if nothing is left.

    Each kept character gives one of the slug, so no more of a text is rewritten than what holds `most`
    of them, however far apart they are.
    """
    kept, gap = "[" + SLUG_BREAK[2:-1], SLUG_BREAK[:-1] + "*+"
    told = F.regexp_extract(text_or_empty(x), f"^{gap}(?:{kept}{gap}){{0,{most}}}+", 0)
    slug = F.regexp_replace(told, SLUG_BREAK, "-")
    slug = F.substring(F.lower(F.regexp_replace(slug, r"^-+|-+$", "")), 1, most)
    # one expression: a CASE evaluates the slug once for its condition and once for its value
    return F.regexp_replace(slug, "^$", "item")


def paper_link(doi: Column, semantic_url: Column, crossref_url: Column) -> Column:
    return first_filled(doi_url(doi), semantic_url, crossref_url)


def api_base(x: Column | str) -> Column:
    """An API root: a Markdown link unwrapped, end slashes and known endpoints removed."""
    url = F.trim(text_or_empty(x))
    linked = F.regexp_extract(url, r"^\[[^\]]*\]\(([^)]+)\)$", 1)
    url = F.when(linked != "", linked).otherwise(url)
    url = F.regexp_replace(url, r"/+$", "")
    return F.regexp_replace(F.regexp_replace(url, API_ENDPOINT, ""), r"/+$", "")


def api_endpoint(base: Column | str, path: str) -> Column:
    return F.concat(api_base(base), F.lit("/" + path.strip("/")))


# Markup


@F.pandas_udf(StringType())
def html_unescape(x: pd.Series) -> pd.Series:
    """All character references, decoded once."""
    return x.map(lambda s: None if s is None else html.unescape(s))


def basic_unescape(x: Column) -> Column:
    """The references of common pages without leaving the JVM; `&amp;` last, so that nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def strip_markup(x: Column | str, unescape=html_unescape) -> Column:
    """Tags become spaces, then references are decoded, then white space collapses."""
    bare = unescape(F.regexp_replace(text_or_empty(x), r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(bare, r"[\s ]+", " "))


def strip_abstract_label(x: Column) -> Column:
    return F.regexp_replace(x, ABSTRACT_LABEL, "")


@F.pandas_udf(StringType())
def normalized_name(x: pd.Series) -> pd.Series:
    """NFKC, case-folded, word characters alone."""
    return x.map(lambda s: re.sub(r"[^\w]", "", unicodedata.normalize("NFKC", s or "").casefold()))


def plain_name(x: Column | str) -> Column:
    """`normalized_name` for names without compatibility characters, as an expression."""
    return F.regexp_replace(F.lower(text_or_empty(x)), NON_WORD, "")


# Dates


def partial_date(parts: Column) -> Column:
    """ISO text of [y], [y, m] or [y, m, d]; impossible days give ''."""
    y, m, d = (F.get(parts, i) for i in range(3))
    month, year = F.lpad(m.cast("string"), 2, "0"), F.lpad(y.cast("string"), 4, "0")
    day = F.concat_ws("-", year, month, F.lpad(d.cast("string"), 2, "0"))
    full = F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day).otherwise("")
    return F.when(F.size(parts) >= 3, F.coalesce(full, F.lit(""))).when(F.size(parts) == 2, F.coalesce(F.concat_ws("-", year, month), F.lit(""))).when(F.size(parts) == 1, F.coalesce(y.cast("string"), F.lit(""))).otherwise("")


def whole_date(x: Column) -> Column:
    """A day for a date of variable precision: YYYY-MM counts as its first day, a bare year or junk as null."""
    padded = F.when(x.rlike(r"^\d{4}-\d{2}$"), F.concat(x, F.lit("-01"))).otherwise(x)
    return F.try_to_date(padded, "yyyy-MM-dd")


def issue_label(d: Column) -> Column:
    number = F.floor((F.dayofmonth(d) - 1) / 7) + 1
    return F.concat(F.date_format(d, "MMMM yyyy"), F.lit(" Issue "), number.cast("string"))


# Lists and vectors


def author_list(names: Column, most: int = 8) -> Column:
    return F.concat(F.array_join(F.slice(names, 1, most), "; "), F.when(F.size(names) > most, " et al.").otherwise(""))


def joined_list(x: Column) -> Column:
    return F.coalesce(F.array_join(x, "; "), F.lit(""))


def from_inverted_index(index: Column) -> Column:
    """Words by position, ties by the word; null or empty gives ''."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda t: t["w"]), " "), F.lit(""))


def with_inverted_index(df: DataFrame, by: list[str], words: Column, name: str = "index") -> DataFrame:
    """by (which identify a row) and the map word -> positions; rows without words have an empty map.

    Two aggregations do this in time linear to the text, and a word's positions are
    gathered by as many tasks as there are words.
    """
    placed = df.select(*by, F.posexplode_outer(words).alias("pos", "word"))
    listed = placed.groupBy(*by, "word").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    entries = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "places")))
    return listed.groupBy(*by).agg(F.map_from_entries(entries).alias(name))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; zero vectors give 0. Norms use whole vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norms))).otherwise(0.0)


# Cells


def escape_html(x: Column | str) -> Column:
    out = text_or_empty(x)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def escape_yaml(x: Column | str) -> Column:
    return F.replace(F.replace(text_or_empty(x), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))


def escape_table(x: Column | str) -> Column:
    return F.replace(F.replace(text_or_empty(x), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def escape_script(x: Column | str) -> Column:
    return F.replace(text_or_empty(x), F.lit("<"), F.lit("\\u003c"))


def search_text(*xs: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *[text_or_empty(x) for x in xs]))


def holds_secret(x: Column | str, known: list[str] | None = None) -> Column:
    text = text_or_empty(x)
    found = text.rlike(SECRET)
    for s in known or []:
        found = found | text.contains(s)
    return found


# Glossary

#: The protected terms and their translations.
GLOSSARY = {
    "scientific knowledge graph": "科学知识图谱",
    "scholarly knowledge graph": "学术知识图谱",
    "document-level information extraction": "文档级信息抽取",
    "entity alignment": "实体对齐",
    "relation extraction": "关系抽取",
    "knowledge graph construction": "知识图谱构建",
    "graph fusion": "图谱融合",
    "evidence grounding": "证据落地",
    "retrieval-augmented generation": "检索增强生成",
    "LLM-as-a-Judge": "LLM 评审器",
    "multi-agent system": "多智能体系统",
    "agentic workflow": "智能体工作流",
    "bibliometrics": "文献计量学",
    "bibliometric": "文献计量学",
    "scientometrics": "科学计量学",
    "informetrics": "信息计量学",
    "science of science": "科学学",
    "scientific information extraction": "科学信息抽取",
    "scientific text mining": "科学文本挖掘",
    "knowledge graph": "知识图谱",
    "GraphRAG": "GraphRAG",
    "factuality": "事实性",
    "hallucination": "幻觉",
    "open science": "开放科学",
    "research evaluation": "科研评价",
    "citation analysis": "引文分析",
}


def glossary_markers(glossary: dict[str, str]) -> list[tuple[str, str, str]]:
    """(term, marker, translation), longest terms first."""
    ordered = sorted(glossary.items(), key=lambda kv: -len(kv[0]))
    return [(term, f"__TERM_{i}__", translation) for i, (term, translation) in enumerate(ordered)]


def protect_terms(x: Column | str, glossary: dict[str, str] = GLOSSARY) -> Column:
    """Terms, in any case, become markers, so that a translator leaves them alone."""
    out = text_or_empty(x)
    for term, marker, _ in glossary_markers(glossary):
        out = F.regexp_replace(out, "(?i)" + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", term), marker)
    return out


def restore_terms(x: Column | str, glossary: dict[str, str] = GLOSSARY) -> Column:
    out = text_or_empty(x)
    for _, marker, translation in glossary_markers(glossary):
        out = F.replace(out, F.lit(marker), F.lit(translation))
    return out
