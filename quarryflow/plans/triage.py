"""The record-triage run: from discovered records to a reading queue.

Every step is a DataFrame; `store` cuts the plan where a result is read twice
or where a judge or translator, which need not repeat itself, has answered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scratch import store
from ..functions.text import first_filled, normalize_doi, normalized_name, protect_terms, restore_terms, stable_id, text_or_empty
from ..operators.dedupe import merge_records
from ..operators.enrich import enrich
from ..operators.judging import VERSION, context_hash, fallback, judge_todo, parsed_or_fallback, prompt, reuse
from ..operators.judgment_log import judge_durably, judgments_of, read_log
from ..operators.ranking import select_capacity, with_cosine, with_semantic_rank
from ..operators.screening import is_candidate, is_excluded, with_keyword_tier
from ..operators.state import Step, update_analysis, upsert, with_ids
from ..operators.stats import priority_stats
from ..sources.files import Profile, Project


@dataclass
class Settings:
    excluded: list[str] = field(default_factory=list)
    projects: list[Project] = field(default_factory=list)
    embedding: bool = False
    threshold: float = 0.45
    model: str = ""
    api_base: str = ""
    temperature: float = 0.1
    caps: dict[str, int] | None = None


@dataclass
class Run:
    """What a run leaves: state and judgments for the next one, all screened records, candidates and queue for readers, counts."""

    state: DataFrame
    judgments: DataFrame
    screened: DataFrame
    candidates: DataFrame
    queue: DataFrame
    stats: DataFrame
    judged_stats: DataFrame


#: What a run learns about a record beside what sources say.
ANALYSIS = ("keyword_tier", "semantic_score", "relevance_score", "priority", "research_track", "related_project")
STATE_SCHEMA = (
    "id long, profile string, stable_id string, doi string, title string, abstract string, publication_date string, venue string, source string, first_seen string, "
    "last_seen string, keyword_tier string, semantic_score double, relevance_score int, priority string, research_track string, related_project string, reading_status string"
)
#: How the table of papers came to its columns.
STATE_STEPS = (Step(1, "reading_status", "'new'"), Step(2, "keyword_tier", "'other'"), Step(3, "semantic_score"), Step(4, "research_track", "''"), Step(5, "related_project", "''"))
JUDGMENT_TABLE = "stable_id string, context_hash string, model string, status string, raw_response string"
FROM_SOURCES = ["doi", "title", "abstract", "publication_date", "venue", "source"]


def triage(
    records: DataFrame,
    profile: Profile,
    settings: Settings,
    now: str,
    state: DataFrame | None = None,
    judgments: DataFrame | None = None,
    look_up: Callable[[DataFrame], DataFrame] | None = None,
    encode: Callable[[pd.Series], pd.Series] | None = None,
    query_vector: list[float] | None = None,
    judge: Callable[[pd.Series], pd.Series] | None = None,
    screened: bool = False,
    log: str | None = None,
    run: str = "run",
    save: Callable[[DataFrame], None] | None = None,
) -> Run:
    """One run over discovered records (with ord, title, abstract, abstract_source, venue, journal, journal_source, doi, doi_raw, doi_url, source, publication_date).

    `look_up` gives the works (for `enrich`) of the records it is shown. Records
    that were `screened` before keep their keyword hits and tiers. Given the folder
    of a `log`, the judge's answers are put down there as they come, under `run`;
    `save` is given the state before the judge is asked, so that a run that dies
    then has not forgotten what it saw.
    """
    spark = records.sparkSession
    state = spark.createDataFrame([], STATE_SCHEMA) if state is None else state
    judgments = spark.createDataFrame([], JUDGMENT_TABLE) if judgments is None else judgments
    keys = ["profile", "stable_id"]
    keyed = records.withColumn("stable_id", stable_id(first_filled("doi_raw", "doi"), "title"))
    merged = merge_records(keyed)
    excluded = [x for x in settings.excluded if x.strip()]
    kept = store(merged.filter(~is_excluded(excluded, normalized_name)) if excluded else merged, "triage-kept")
    batch = kept.select(F.lit(profile.name).alias("profile"), "stable_id", normalize_doi(first_filled("doi_raw", "doi")).alias("doi"), "title", "abstract", "publication_date", first_filled("venue", "journal").alias("venue"), "source", F.lit(now).alias("seen_at"), "ord")
    defaults = {"reading_status": F.lit("new"), "keyword_tier": F.lit("other")}
    after = store(upsert(state, batch, keys, FROM_SOURCES, defaults), "triage-upserted")
    after = store(with_ids(after, keys), "triage-state")
    known = after.filter("in_batch").select("stable_id", F.col("id").alias("paper_id"), "is_new", "first_seen", "reading_status")
    kept = kept.drop("paper_id", "is_new", "first_seen", "reading_status").join(known, "stable_id")
    if save:
        save(after.drop("is_new", "in_batch"))
    no_topics = F.array().cast("array<string>")
    rich = store(enrich(kept, look_up(kept)), "triage-rich") if look_up else kept if "all_topics" in kept.columns else kept.withColumn("all_topics", no_topics)
    tiered = _with_screening_defaults(rich) if screened else with_keyword_tier(rich, profile.keywords, "all_topics")
    if settings.embedding and encode:
        scored = with_cosine(tiered.withColumn("embedding", _vectors(encode)(_shown())), F.array(*map(F.lit, query_vector or []))).drop("embedding")
        scored = with_semantic_rank(store(scored, "triage-scored"))
    else:
        scored = tiered.withColumn("semantic_score", F.lit(None).cast("double")).withColumn("semantic_rank", F.lit(None).cast("int"))
    candidate = is_candidate(settings.embedding, settings.threshold)
    named = scored.withColumn("is_candidate", candidate).withColumn("model", F.lit(settings.model)).withColumn("context_hash", context_hash(_context(profile, settings)))
    scanned, judged_rows = Observation(), Observation()
    everything = store(named.observe(scanned, F.count("*").alias("n")), "triage-screened")
    candidates = everything.filter("is_candidate").drop("is_candidate")
    on = ["stable_id", "context_hash", "model"]
    names = [p.name for p in settings.projects]
    if judge:
        reused, todo = reuse(candidates, judgments.select(*on, "status", "raw_response"), on)
        request = prompt(profile.description, [p.prompt for p in settings.projects])
        if log:
            answered = judge_durably(todo, judge, request, log, run, projects=names)
            answers = judgments_of(read_log(spark, log), run, projects=names).select(*on, "status", "raw_response")
        else:
            asked = store(judge_todo(todo, judge, request, names), "triage-judged")
            answered = asked.withColumn("judge_checkpoint", F.when(F.col("status") == "complete", "completed").otherwise("failed-fallback"))
            answers = asked.select(*on, "status", "raw_response")
        judged = reused.withColumn("judge_checkpoint", F.lit("reused")).unionByName(answered)
        judgments = judgments.join(answers.select(*on), on, "left_anti").select(*on, "status", "raw_response").unionByName(answers)
    else:
        judged = candidates.withColumn("status", F.lit("none")).withColumn("raw_response", F.lit("")).withColumn("judge_checkpoint", F.lit("disabled"))
    done = store(parsed_or_fallback(judged).observe(judged_rows, F.count("*").alias("n")), "triage-done")
    rest = everything.filter("NOT is_candidate").select("*", fallback(F.col("keyword_tier"), F.col("matched_keywords")).alias("j"))
    learned = [c for c in ANALYSIS if c not in ("keyword_tier", "semantic_score")]
    shown = ["stable_id", "title", "abstract", first_filled("venue", "journal").alias("venue"), "keyword_tier", "semantic_score"]
    analysed = done.select(*shown, *learned).unionByName(rest.select(*shown, *[F.col(f"j.{c}").alias(c) for c in learned]))
    after = update_analysis(after, analysed.withColumn("profile", F.lit(profile.name)), keys, ["title", "abstract", "venue", *ANALYSIS])
    queue = select_capacity(done, settings.caps or profile.caps, profile.weekly_capacity)
    counts = [F.lit(n).alias(name) for name, n in (("scanned", scanned.get["n"]), ("candidates", judged_rows.get["n"]))]
    return Run(after, judgments, everything, done, queue, priority_stats(queue, *counts), priority_stats(done, *counts))


def _with_screening_defaults(records: DataFrame) -> DataFrame:
    """Records of a screened snapshot: what it lacks of hits and tiers is empty, and `tier` stands in for keyword_tier."""
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) if c in records.columns else F.array().cast("array<string>") for c in ("matched_keywords", "core_hits", "proxy_hits", "eco_hits")}
    tiers = [c for c in ("keyword_tier", "tier") if c in records.columns]
    return records.withColumns({**lists, "keyword_tier": F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in tiers], F.lit("other"))})


def _shown() -> Column:
    return F.concat(text_or_empty("title"), F.lit("\n"), text_or_empty("abstract"))


def _vectors(encode: Callable[[pd.Series], pd.Series]):
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return encode(texts)

    return run


def _context(profile: Profile, settings: Settings) -> dict[str, Column]:
    """Every input of a judgment."""
    projects = "\n\n".join(p.prompt for p in settings.projects)
    fixed = {"profile": profile.description, "projects": projects, "model": settings.model, "api_base": settings.api_base, "temperature": str(settings.temperature), "version": VERSION}
    fields = {c: F.col(c).cast("string") for c in ("title", "abstract", "venue", "journal", "keyword_tier", "semantic_score")}
    return {k: F.lit(v) for k, v in fixed.items()} | fields | {"matched_keywords": F.array_join("matched_keywords", "\x1f")}


def translate(df: DataFrame, run: Callable[[pd.Series], pd.Series], most: int = 3000) -> DataFrame:
    """Fills title_cn and abstract_cn where they are missing, glossary terms protected; abstracts up to `most` characters."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return run(texts)

    for column, source in (("title_cn", F.col("title")), ("abstract_cn", F.substring("abstract", 1, most))):
        have = text_or_empty(column) if column in df.columns else F.lit("")
        df = df.withColumn(column, F.when(have != "", have).otherwise(F.coalesce(restore_terms(ask(protect_terms(source))), F.lit(""))))
    return df
