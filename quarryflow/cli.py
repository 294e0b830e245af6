"""Command line: `python -m quarryflow.cli triage|scan|screen|enrich|render|feedback ...`; prints a JSON summary, exits 2 on bad input.

`triage` is the whole run: discovery (or a snapshot of it), merging, state,
enrichment, screening, judging, queue, outputs. The other commands are its
steps alone. Keys for model and search APIs come from the environment
(QUARRYFLOW_API_KEY, QUARRYFLOW_SEARCH_KEY), never from arguments or files.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.scratch import clean_scratch, delete, write_file
from .functions.text import first_filled
from .operators.dedupe import first_by_doi, first_by_key, venue_key
from .operators.ranking import top_per_group, window_bounds
from .operators.screening import TIERS, matches_alias, with_keyword_tier
from .operators.state import FEEDBACK, apply_feedback, feedback_rows, finish_run, read_or_empty, read_version, resolve_feedback, start_run, write_version
from .operators.enrich import enrich
from .plans import outputs
from .plans.triage import JUDGMENT_TABLE, STATE_SCHEMA, STATE_STEPS, Settings, translate, triage
from .sources import files, models, providers, records

#: The addresses of the public APIs.
CROSSREF = "https://api.crossref.org/works"
SEMANTIC = "https://api.semanticscholar.org/graph/v1"
OPENALEX = "https://api.openalex.org/works"
RECORD = "ord long, title string, abstract string, abstract_source string, publication_date string, venue string, journal string, journal_source string, pool string, authors string, doi string, doi_raw string, doi_url string, source string"


def crossref(spark: SparkSession, venues: DataFrame, from_date: str, to_date: str, most: int, base_url: str = CROSSREF, by_doi: bool = False, **options: object) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of the watched venues. The list is short, one partition for each venue.

    Proceedings of other conferences that a search by name brings are left out;
    each venue gives `most` records at most, and a work that two venues give comes
    once, known by its DOI or its title, or with `by_doi` by its DOI alone.
    """
    keys = [r.asDict(recursive=True) for r in venues.collect()]
    items, errors = providers.discover(spark, "crossref", keys, base_url=base_url, from_date=from_date, to_date=to_date, max_per_key=most, **options)
    venue = F.from_json("key", "kind string, journal string, venue string, pool string, aliases array<string>")
    found = records.crossref_records(items.select(F.col("row_ord").alias("ord"), "key", "item", venue.alias("venue")))
    names = F.from_json("key", "kind string, venue string, aliases array<string>")
    aliases = F.concat(F.array(first_filled(names["venue"])), F.coalesce(names["aliases"], F.array().cast("array<string>")))
    wanted = found.filter((first_filled(names["kind"]) != "conference") | matches_alias("journal", aliases))
    capped = top_per_group(wanted, ["key"], [F.col("ord")], most).drop("key")
    return (first_by_doi(capped, "doi_raw") if by_doi else first_by_key(capped, venue_key("doi_raw", "title"))), errors


def semantic(spark: SparkSession, queries: list[str], from_date: str, to_date: str, most: int, base_url: str = SEMANTIC, **options: object) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of the search queries; a work that two queries find comes once."""
    items, errors = providers.discover(spark, "semantic_scholar", [{"query": q} for q in queries], base_url=base_url, from_date=from_date, to_date=to_date, max_per_key=most, **options)
    query = F.get_json_object("key", "$.query")
    found = records.semantic_records(items.select((F.col("row_ord") + (1 << 56)).alias("ord"), "item", query.alias("query")))
    return first_by_key(found, venue_key("doi_raw", "title")), errors


def works_of(kept: DataFrame, base_url: str = OPENALEX, **options: object) -> DataFrame:
    """The works behind the records' DOIs, fifty a request, asked for on the executors."""
    found = providers.look_up(providers.doi_batches(kept), {"base_url": base_url, **{k: str(v) for k, v in options.items()}})
    return records.openalex_works(found.filter("work IS NOT NULL"))


def watched(spark: SparkSession, paths: list[str], pools: list[str], scan: bool = False) -> DataFrame:
    """The venues to ask for. A choice of pools leaves conferences out; a scan skips journals without an ISSN."""
    venues = files.read_venues(spark, *paths)
    conference = F.coalesce(F.col("kind") == "conference", F.lit(False))
    venues = providers.in_pools(venues.filter(~conference) if pools else venues, pools)
    return venues.filter(conference | (F.coalesce(F.trim("issn"), F.lit("")) != "")) if scan else venues


def discovered(spark: SparkSession, a: argparse.Namespace, profile: files.Profile, start: str, end: str, scan: bool = False) -> tuple[DataFrame, list[DataFrame], bool]:
    """(records, error tables, whether they were screened before)."""
    if a.records:
        return spark.read.parquet(a.records), [], False
    if a.screened:
        return spark.read.json(a.screened), [], True
    if a.scan:
        return files.read_scan(spark, a.scan, RECORD), [], False
    parts, errors = [], []
    common = {"pause": a.pause, "timeout": a.timeout, "tries": a.tries, "lanes": a.lanes, "pages": a.pages}
    if "crossref" in a.data_sources:
        found, failed = crossref(spark, watched(spark, a.venues, a.pools, scan), start, end, a.max_per_venue, a.crossref_url, scan, **common)
        parts, errors = [*parts, found], [*errors, failed]
    if "semantic_scholar" in a.data_sources:
        queries = providers.semantic_queries(a.queries or None, profile.name, profile.keywords["core"])
        found, failed = semantic(spark, queries, start, end, a.max_per_query, a.semantic_url, api_key=os.environ.get("QUARRYFLOW_SEARCH_KEY", ""), **common)
        parts, errors = [*parts, found], [*errors, failed]
    if not parts:
        raise ValueError("no data source is chosen")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, errors, False


def run_triage(spark: SparkSession, a: argparse.Namespace) -> dict:
    profile = files.read_profile(spark, a.profile)
    projects = [files.read_project(spark, p) for p in a.project]
    start, end = window_bounds(a.from_date, a.to_date, a.days, datetime.now(UTC).date().isoformat())
    now = datetime.now(UTC).isoformat(timespec="seconds")
    run_id = start_run(spark, f"{a.out}/runs", profile.name, start, end, now)
    found, errors, screened = discovered(spark, a, profile, start, end)
    state, at = read_or_empty(spark, a.state or f"{a.out}/state", "papers", STATE_SCHEMA, STATE_STEPS)
    judgments, judged_at = read_or_empty(spark, a.state or f"{a.out}/state", "judgments", JUDGMENT_TABLE)
    key = os.environ.get("QUARRYFLOW_API_KEY", "")
    post = models.poster(key, a.timeout, a.tries)
    judge = models.chat_judge(a.api_base, a.model, post, a.temperature) if a.model else None
    encode = models.encoder(a.api_base, a.embedding_model, post) if a.embedding_model else None
    vector = encode(_texts(profile.description))[0] if encode else None
    caps = files.merged(profile.caps, a.caps) if a.caps else None
    settings = Settings(a.exclude, projects, bool(encode), a.threshold, a.model, a.api_base, a.temperature, caps)
    look_up = (lambda kept: works_of(kept, a.openalex_url, pause=a.pause, timeout=a.timeout, tries=a.tries, lanes=a.lanes)) if a.enrich else None
    root = a.state or f"{a.out}/state"
    log = f"{root}/judgment_log"
    if judge:  # what was seen outlives a run that dies while the judge is asked
        versions = iter((at + 1, at + 2))
        run = triage(found, profile, settings, now, state, judgments, look_up, encode, vector, judge, screened, log, run_id, lambda seen: write_version(seen, root, "papers", next(versions)))
    else:
        versions = iter((at + 1,))
        run = triage(found, profile, settings, now, state, judgments, look_up, encode, vector, judge, screened)
    # judgments first: a crash in between leaves no paper analysed by judgments that are not there
    write_version(run.judgments, root, "judgments", judged_at + 1)
    write_version(run.state.drop("is_new", "in_batch"), root, "papers", next(versions))
    delete(spark, f"{log}/run={run_id}")
    queued = run.queue.select("stable_id", F.lit(True).alias("in_queue"))  # the weekly capacity at most
    candidates = run.candidates.join(F.broadcast(queued), "stable_id", "left").withColumn("in_queue", F.coalesce("in_queue", F.lit(False)))
    candidates = translate(candidates, models.chat_translator(a.api_base, a.translation_model, post)) if a.translation_model else candidates
    for stage, rows in (("scan", run.screened.drop("context_hash", "model", "is_candidate")), ("screened", run.screened), ("judged", candidates)):
        outputs.snapshot(rows, a.out, profile.name, end, f"{stage}-{run_id}")
    stats = run.stats.first().asDict()
    written = render(spark.read.json(outputs.snapshot_path(a.out, profile.name, end, f"judged-{run_id}")), a, profile.name, stats, run_id)
    failed = [r.asDict() for e in errors for r in e.collect()]
    finish_run(spark, f"{a.out}/runs", run_id, stats, json.dumps(failed), datetime.now(UTC).isoformat(timespec="seconds"))
    return {"run_id": run_id, "stats": stats, "judged": run.judged_stats.first().asDict(), "errors": failed, "written": written, "preview": outputs.preview(run.queue, stats, a.limit)}


def _texts(text: str):
    import pandas as pd

    return pd.Series([text])


def render(judged: DataFrame, a: argparse.Namespace, profile: str, stats: dict, run_id: str) -> list[str]:
    """Writes the chosen outputs of judged records below a.out; returns their paths."""
    written = []
    for mode in a.outputs:
        path = f"{a.out}/{run_id}/{mode}"
        if mode == "notes":
            outputs.write_note_files(judged.filter("in_queue"), path)
        elif mode == "sheets":
            outputs.write_sheets(judged, path)
        else:
            pieces = {"html": lambda: outputs.report(judged, profile, stats), "app": lambda: [outputs.app(judged, profile, stats)], "excel": lambda: [outputs.workbook(judged, stats)]}[mode]()
            path += {"html": ".html", "app": ".app.html", "excel": ".xlsx"}[mode]
            write_file(judged.sparkSession, path, (piece if isinstance(piece, bytes) else piece.encode() for piece in pieces))
        written.append(path)
    return written


def run_scan(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Discovery alone: records as JSON lines, one for each DOI, which `triage --scan` takes."""
    start, end = window_bounds(a.from_date, a.to_date, a.days, datetime.now(UTC).date().isoformat())
    profile = files.read_profile(spark, a.profile)
    found, errors, _ = discovered(spark, a, profile, start, end, True)
    written = Observation()
    found.observe(written, F.count("*").alias("n")).write.mode("errorifexists").json(a.out)
    failed = [r.asDict() for e in errors for r in e.collect()]
    return {"found": written.get["n"], "errors": failed}


def run_screen(spark: SparkSession, a: argparse.Namespace) -> dict:
    if not a.records and not a.scan:
        raise ValueError("missing: records or scan")
    rows = spark.read.parquet(a.records) if a.records else files.read_scan(spark, a.scan, RECORD, a.field)
    tiers = with_keyword_tier(rows, files.read_profile(spark, a.profile).keywords)
    counts = Observation()
    each = [F.count_if(F.col("keyword_tier") == t).alias(t) for t in (*TIERS, "other")]
    tiers.observe(counts, *each).write.mode("errorifexists").parquet(a.out)
    return {t: n for t, n in counts.get.items() if n}


def run_enrich(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Fills abstracts and topics of records."""
    rows = spark.read.parquet(a.records)
    written = Observation()
    rich = enrich(rows, works_of(rows, a.openalex_url, pause=a.pause, timeout=a.timeout, tries=a.tries, lanes=a.lanes))
    rich.observe(written, F.count("*").alias("n")).write.mode("errorifexists").parquet(a.out)
    return {"records": written.get["n"]}


def run_render(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The outputs of a judged snapshot."""
    return {"written": render(spark.read.json(a.judged), a, a.name, {}, "rendered")}


def run_feedback(spark: SparkSession, a: argparse.Namespace) -> dict:
    papers, version = read_version(spark, a.state, "papers")
    accepted, errors = resolve_feedback(files.read_feedback(spark, a.feedback), papers)
    table, at = read_or_empty(spark, a.state, "feedback", FEEDBACK)
    write_version(table.unionByName(feedback_rows(accepted, datetime.now(UTC).isoformat(timespec="seconds"))), a.state, "feedback", at + 1)
    write_version(apply_feedback(papers, accepted), a.state, "papers", version + 1)
    return {"imported": accepted.count(), "errors": [r.error for r in errors.orderBy("ord").collect()]}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarryflow")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, required: tuple[str, ...]) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--config", help="a JSON file of options; those of the command line go before it")
        for r in required:
            p.add_argument(r)
        p.set_defaults(run=run, parser=p, required=[r[2:] for r in required], caps=None)
        return p

    def web(p: argparse.ArgumentParser) -> None:
        for name, kind, default in (("--pause", float, 0.2), ("--timeout", float, 30), ("--tries", int, 3), ("--lanes", int, 1), ("--openalex-url", str, OPENALEX)):
            p.add_argument(name, type=kind, default=default)

    def search(p: argparse.ArgumentParser) -> None:
        web(p)
        p.add_argument("--pages", default="", help="a folder of pages that are not asked for again, for scans that died")
        p.add_argument("--records", help="a Parquet table of records instead of a scan")
        p.add_argument("--scan", help="a scan's JSON lines instead of a scan")
        p.add_argument("--screened", help="JSON lines of records screened before")
        for name in ("--from-date", "--to-date"):
            p.add_argument(name)
        for name in ("--venues", "--pools", "--queries"):
            p.add_argument(name, nargs="*", default=[])
        p.add_argument("--data-sources", nargs="+", default=["crossref"], choices=["crossref", "semantic_scholar"])
        for name, n in (("--days", 7), ("--max-per-venue", 50), ("--max-per-query", 100)):
            p.add_argument(name, type=int, default=n)
        p.add_argument("--crossref-url", default=CROSSREF)
        p.add_argument("--semantic-url", default=SEMANTIC)

    def modes(p: argparse.ArgumentParser) -> None:
        p.add_argument("--outputs", nargs="*", default=["notes"], choices=["notes", "sheets", "html", "app", "excel"])

    t = command("triage", run_triage, ("--profile", "--out"))
    search(t)
    modes(t)
    t.add_argument("--state", help="the folder of the state tables; below --out, if not given")
    t.add_argument("--enrich", action="store_true")
    for name in ("--exclude", "--project"):
        t.add_argument(name, nargs="*", default=[])
    for name in ("--model", "--api-base", "--embedding-model", "--translation-model"):
        t.add_argument(name, default="")
    for name, x in (("--temperature", 0.1), ("--threshold", 0.45)):
        t.add_argument(name, type=float, default=x)
    t.add_argument("--limit", type=int, default=50)
    search(command("scan", run_scan, ("--profile", "--out")))
    s = command("screen", run_screen, ("--profile", "--out"))
    s.add_argument("--records", help="a Parquet table of records")
    s.add_argument("--scan", help="a scan's JSON instead, of which --field chooses")
    s.add_argument("--field", default="both", choices=["new", "already_seen", "both"])
    web(command("enrich", run_enrich, ("--records", "--out")))
    r = command("render", run_render, ("--judged", "--out"))
    r.add_argument("--name", default="records")
    modes(r)
    command("feedback", run_feedback, ("--feedback", "--state"))
    return top


#: Options that are paths; in a settings file they are relative to it.
PATHS = ("profile", "out", "state", "pages", "records", "scan", "screened", "judged", "feedback", "venues", "project")


def _options(spark: SparkSession, argv: list[str] | None) -> argparse.Namespace:
    """The options of the command line over those of its settings file."""
    a = _parser().parse_args(argv)
    if a.config:
        settings = {k.replace("-", "_"): v for k, v in files.read_settings(spark, a.config, {}).items()}
        folder = a.config.rpartition("/")[0] or "."
        for name in settings.keys() & set(PATHS):
            v = settings[name]
            settings[name] = [files.resolve(x, folder) for x in v] if isinstance(v, list) else files.resolve(v, folder)
        known = vars(a).keys() - {"run", "parser", "required", "config"}
        if unknown := settings.keys() - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        a.parser.set_defaults(**settings)
        given = a.parser.parse_args((sys.argv[1:] if argv is None else argv)[1:])
        a = given
    if missing := [r for r in a.required if not getattr(a, r)]:
        raise ValueError(f"missing: {', '.join(missing)}")
    return a


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.getOrCreate()
    try:
        a = _options(spark, argv)
        out = a.run(spark, a)
    except (ValueError, FileNotFoundError, json.JSONDecodeError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2
    finally:
        clean_scratch(spark)
    print(json.dumps(out, ensure_ascii=False))
    return 1 if out.get("errors") else 0


if __name__ == "__main__":
    sys.exit(main())
