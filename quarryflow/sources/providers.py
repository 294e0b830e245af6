"""Paged HTTP APIs as a Spark data source: venues, queries or batches of DOIs dealt to lanes of a held rate.

`spark.read.format("paged_api")` reads items and errors as rows, `readStream` the
days that a scan has not read yet; what one key fails to fetch becomes an error
row, and the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from itertools import islice
from typing import Any
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.scratch import qualified, store
from ..functions.text import normalize_doi
from .http import Client, Paced, Patience
from .page_log import Logged

SCHEMA = "provider string, key string, row_ord long, item string, error string"
Fetch = Callable[[str], dict[str, Any]]

#: The most rows of one page or request that the APIs give.
CROSSREF_ROWS, SEMANTIC_ROWS, OPENALEX_DOIS = 100, 1000, 50


def crossref_query(venue: dict[str, Any], options: dict[str, str]) -> dict[str, Any]:
    """The parameters of the works of a venue in a time span, as the API documents them."""
    conference = venue.get("kind") == "conference"
    wanted = {
        "issn": venue.get("issn"),
        "from-pub-date": options["from_date"],
        "until-pub-date": options["to_date"],
        "type": "proceedings-article" if conference else None,
    }
    query = {"filter": ",".join(f"{name}:{value}" for name, value in wanted.items() if value), "rows": min(CROSSREF_ROWS, int(options.get("max_per_key", 50)))}
    return query | ({"query.container-title": venue.get("query") or venue.get("venue")} if conference else {})


def cursor_pages(url: str, query: dict[str, Any], fetch: Fetch) -> Iterator[list[dict]]:
    """The pages of a deep-paging query; each names the cursor of the next, and an empty one is the last."""
    cursor = "*"
    while cursor:
        found = fetch(f"{url}?{urlencode({**query, 'cursor': cursor})}").get("message") or {}
        items = found.get("items") or []
        if items:
            yield items
        cursor = found.get("next-cursor") if items else None


def crossref_pages(venue: dict[str, Any], options: dict[str, str], fetch: Fetch) -> Iterator[dict]:
    """A venue's items. Whole pages are read until they hold the cap, which counts the rows scanned."""
    query = crossref_query(venue, options)
    pages = -(-int(options.get("max_per_key", 50)) // query["rows"])
    for page in islice(cursor_pages(options["base_url"], query, fetch), pages):
        yield from page


def semantic_pages(query: dict[str, Any], options: dict[str, str], fetch: Fetch) -> Iterator[dict]:
    """A query's items, newest first, up to the cap."""
    params = {"query": query["query"], "publicationDateOrYear": f"{options['from_date']}:{options['to_date']}", "sort": "publicationDate:desc"}
    if options.get("fields"):
        params["fields"] = options["fields"]
    data = fetch(f"{options['base_url']}/paper/search/bulk?{urlencode(params)}").get("data") or []
    yield from data[: max(1, min(SEMANTIC_ROWS, int(options.get("max_per_key", 100))))]


def openalex_pages(batch: dict[str, Any], options: dict[str, str], fetch: Fetch) -> Iterator[dict]:
    """The works of one batch of DOIs."""
    params = {"filter": "doi:" + "|".join(batch["dois"]), "per-page": OPENALEX_DOIS, "select": "doi,abstract_inverted_index,primary_topic,topics"}
    yield from fetch(f"{options['base_url']}?{urlencode(params)}").get("results") or []


PAGERS: dict[str, Callable[..., Iterator[dict]]] = {"crossref": crossref_pages, "semantic_scholar": semantic_pages, "openalex": openalex_pages}


class _Lane(InputPartition):
    """Keys that one task asks for in turn, with their numbers, and the dates of the scan."""

    def __init__(self, at: int, keys: list[tuple[int, dict[str, Any]]], dates: dict[str, str]):
        super().__init__(at)
        self.keys, self.dates = keys, dates


def _lanes(options: dict[str, str], dates: dict[str, str]) -> list[_Lane]:
    """All keys dealt over the lanes: tasks run side by side, so the rate is that of a lane times their number."""
    keys = list(enumerate(json.loads(options["keys"])))
    n = max(1, min(len(keys), int(options.get("lanes", 1))))
    return [_Lane(i, keys[i::n], dates) for i in range(n)]


def _read_lane(lane: _Lane, options: dict[str, str]) -> Iterator[tuple]:
    """Items and errors of a lane's keys; two requests begin `pause` seconds apart at least."""
    provider, options = options["provider"], {**options, **lane.dates}
    headers = {"x-api-key": options["api_key"]} if options.get("api_key") else None
    client = Client(Patience(float(options.get("timeout", 30)), int(options.get("tries", 3))), headers)
    fetch: Fetch = Paced(client, float(options.get("pause", 0)))
    fetch = Logged(fetch, options["pages"]) if options.get("pages") else fetch
    for at, key in lane.keys:
        name = json.dumps(key, ensure_ascii=False, sort_keys=True)
        try:
            for i, item in enumerate(PAGERS[provider](key, options, fetch)):
                yield provider, name, (at << 32) + i, json.dumps(item, ensure_ascii=False), None
        except Exception as e:  # one key's failure is a row, the rest goes on
            yield provider, name, (at << 32) + (1 << 31), None, f"{type(e).__name__}: {e}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[_Lane]:
        return _lanes(self.options, {})

    def read(self, partition: _Lane) -> Iterator[tuple]:
        return _read_lane(partition, self.options)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the last day that was scanned, so a scan that starts anew asks for the days after it alone."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"until": (date.fromisoformat(self.options["from_date"]) - timedelta(days=1)).isoformat()}

    def latestOffset(self) -> dict:
        return {"until": max(self.options["to_date"], self.initialOffset()["until"])}

    def partitions(self, start: dict, end: dict) -> list[_Lane]:
        first = (date.fromisoformat(start["until"]) + timedelta(days=1)).isoformat()
        return _lanes(self.options, {"from_date": first, "to_date": end["until"]}) if first <= end["until"] else []

    def read(self, partition: _Lane) -> Iterator[tuple]:
        return _read_lane(partition, self.options)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offset."""

    def stop(self) -> None:
        """Nothing is held open."""


class PagedApi(DataSource):
    """Options: provider, keys (a JSON list of venues, queries or DOI batches), base_url, from_date, to_date, max_per_key, lanes, pause, timeout, tries, api_key, pages.

    The rate is held: `lanes` tasks (one, if not given) ask in turn, each once in
    `pause` seconds. pages: the address of a folder whose answers are not asked
    for again. As a stream it gives each day once, whenever it is started.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def discover(spark: SparkSession, provider: str, keys: list[dict[str, Any]], **options: Any) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of a provider over its keys, of one scan: what it brings is stored before it is read."""
    spark.dataSource.register(PagedApi)
    options = {**options, "pages": qualified(spark, options["pages"])} if options.get("pages") else options
    rows = spark.read.format("paged_api").options(provider=provider, keys=json.dumps(keys), **{k: str(v) for k, v in options.items()}).load()
    rows = store(rows, "discovered")
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("provider", "key", "error")


def discover_stream(spark: SparkSession, provider: str, keys: list[dict[str, Any]], **options: Any) -> DataFrame:
    """What a provider has over its keys as a stream of rows (item or error), each day of the span once.

    A start of it scans the days since the last one that its checkpoint has. A
    start that died is repeated for the same days; with a folder of `pages` it
    asks only for the pages that had not been answered.
    """
    spark.dataSource.register(PagedApi)
    options = {**options, "pages": qualified(spark, options["pages"])} if options.get("pages") else options
    return spark.readStream.format("paged_api").options(provider=provider, keys=json.dumps(keys), **{k: str(v) for k, v in options.items()}).load()


def doi_batches(records: DataFrame, doi: str = "doi_raw", most: int = OPENALEX_DOIS) -> DataFrame:
    """key: each batch of up to `most` distinct DOIs as a JSON object, numbered in their order by partition."""
    found = records.select(normalize_doi(doi).alias("doi")).filter("doi <> ''").distinct()
    placed = found.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    batches = placed.groupBy("part", F.floor(F.col("place") / most).alias("batch")).agg(F.collect_list("doi").alias("dois"))
    return batches.select(F.to_json(F.struct("dois")).alias("key"))


def look_up(batches: DataFrame, options: dict[str, str], fetch: Fetch | None = None) -> DataFrame:
    """work, error of each batch, asked for on the executors at a held rate, as `lanes` and `pause` say; a batch that fails is an error row."""
    client = fetch or Client(Patience(float(options.get("timeout", 30)), int(options.get("tries", 3))))
    pause = float(options.get("pause", 0))

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        paced = Paced(client, pause)
        for pdf in parts:
            rows = []
            for key in pdf["key"]:
                try:
                    rows += [(json.dumps(w, ensure_ascii=False), None) for w in openalex_pages(json.loads(key), options, paced)]
                except Exception as e:  # one batch's failure is a row, the rest goes on
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["work", "error"], dtype=object)

    # a partition is a lane
    return batches.repartition(max(1, int(options.get("lanes", 1)))).mapInPandas(run, "work string, error string")


def semantic_queries(configured: Any, profile: str, core_keywords: list[str]) -> list[str]:
    """The configured list, or the profile's list of a dict, else the first four core keywords; each once."""
    chosen = configured.get(profile) if isinstance(configured, dict) else configured
    return list(dict.fromkeys(chosen or core_keywords[:4]))


def in_pools(venues: DataFrame, pools: list[str]) -> DataFrame:
    return venues.filter(F.col("pool").isin(pools)) if pools else venues
