"""Record operators on small cases: merging, screening, judging, state, feedback, sources."""

import json
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryflow import cli
from quarryflow.functions import scratch
from quarryflow.functions import text as X
from quarryflow.operators import dedupe, judging, ranking, screening, state
from quarryflow.operators.enrich import enrich
from quarryflow.plans import outputs
from quarryflow.plans.triage import Settings, translate, triage
from quarryflow.sources import files, http, models, providers, records
from quarryflow.streaming.state_stream import stream_upserts

PAPERS = [
    (0, "Document-level scientific knowledge graph construction with relation extraction", "We study scholarly document processing and scientific claim extraction.", "2026-09-02", "Knowledge-Based Systems", "10.1000/kg.1"),
    (1, "Responsible research evaluation using citation analysis", "A scientometrics study of research assessment and scientific impact.", "2026-09-01", "Scientometrics", "10.1000/science.2"),
    (2, "Calibrating trust in human-AI decision making", "We examine AI reliance, algorithm aversion, and human-AI collaboration.", "2026-08-31", "Computers in Human Behavior", "10.1000/hai.3"),
]
KEYWORDS = {"core": ["scientific knowledge graph"], "proxy": ["relation extraction", "citation analysis"], "eco": ["human-AI"]}
PROFILE = files.Profile("kg", "Scholarly knowledge graphs", KEYWORDS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.fixture
def found(spark):
    rows = [(o, t, a, d, v, v, v, doi, doi, f"https://doi.org/{doi}", "crossref", "crossref") for o, t, a, d, v, doi in PAPERS]
    return spark.createDataFrame(rows, "ord long, title string, abstract string, publication_date string, venue string, journal string, journal_source string, doi string, doi_raw string, doi_url string, source string, abstract_source string")


def test_identifiers(spark):
    assert one(spark, X.normalize_doi(F.lit(" HTTPS://DX.doi.org/10.1/A "))) == "10.1/a"
    assert one(spark, X.normalize_doi(F.lit("doi:10.1/a"))) == "doi:10.1/a"
    assert one(spark, X.stable_id(F.lit(""), F.lit("A  Useful Paper"))) == one(spark, X.stable_id(F.lit(None), F.lit("a useful paper")))
    assert one(spark, X.slugify(F.lit("--Ünder & Over!"))) == "nder-over"
    assert one(spark, X.slugify(F.lit("!!!"))) == "item"
    for url in ("https://a.b/v1", "https://a.b/v1/chat/completions", "https://a.b/v1/embeddings/", "[x](https://a.b/v1)"):
        assert one(spark, X.api_base(F.lit(url))) == "https://a.b/v1"


def test_slugs_of_long_texts_and_far_apart_characters(spark):
    far = "\n".join([" é🙂\u2028" * 30_000, "Ab", "-" * 70_000, "c知", "?" * 50_000])
    texts = [None, "", "a", "-a-", far, far * 50, "x" * 79 + " y", "x" * 78 + " y z", "x" * 80 + "-", "x" * 200, "a\n\n", "知 识\t" * 60, "É" * 300]
    texts += [f"{'é' * (i % 4)}{'Word, ' * i}{'-' * (i % 3)}" for i in range(40)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.slugify("t").alias("s"), X.slugify("t", 3).alias("three"))
    for r in got.collect():
        whole = re.sub("^-+|-+$", "", re.sub(X.SLUG_BREAK, "-", texts[r.i] or "")).lower()
        assert (r.s, r.three) == (whole[:80] or "item", whole[:3] or "item"), r.i


def test_a_slug_costs_less_than_its_text(spark):
    texts = spark.range(0, 24, 1, 4).select(F.repeat(F.concat_ws(", ", F.col("id"), F.lit("some words of a long text")), 10_000).alias("t")).localCheckpoint()

    def seconds(c):
        start = time.perf_counter()
        texts.agg(F.max(c)).collect()
        return time.perf_counter() - start

    rewritten, slug = ([seconds(c) for _ in range(3)] for c in (F.regexp_replace("t", X.SLUG_BREAK, "-"), X.slugify("t")))
    assert min(slug) < min(rewritten) / 2


def test_markup_and_dates(spark):
    assert one(spark, X.strip_markup(F.lit("<p>a&amp;quot;<b>b</b>&nbsp; c</p>"))) == "a&quot; b c"
    assert one(spark, X.strip_abstract_label(F.lit("Abstract. Text"))) == "Text"
    parts = lambda *p: F.array(*map(F.lit, p)).cast("array<int>")
    assert [one(spark, X.partial_date(parts(*p))) for p in ((2024, 2, 30), (2024, 2, 9), (2024, 2), (2024,), ())] == ["", "2024-02-09", "2024-02", "2024", ""]
    assert str(one(spark, X.whole_date(F.lit("2024-02")))) == "2024-02-01"
    assert one(spark, X.whole_date(F.lit("soon"))) is None


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, X.cosine(v(1, 0), v(1, 0))) == 1.0
    assert one(spark, X.cosine(v(1, 0), v(-1, 0))) == 0.0
    assert one(spark, X.cosine(v(1, 0), v(0, 0))) == 0.0
    assert one(spark, X.cosine(v(3, 4, 9), v(3, 4))) == pytest.approx(25 / (106**0.5 * 5))


@pytest.mark.parametrize(
    ("columns", "listed", "want"),
    [
        ({"venue": "PLoS ONE"}, ["PLOS ONE"], True),
        ({"journal": "PLOS  One"}, ["PLOS ONE"], True),
        ({"journal_source": "plos-one"}, ["PLOS ONE"], True),
        ({"doi_url": "https://doi.org/10.1371/journal.pone.0357186"}, ["PLOS ONE"], True),
        ({"venue": "PLOS Biology", "doi": "10.1371/journal.pbio.123"}, ["PLOS ONE"], False),
        ({"venue": "Scientometrics"}, ["PLOS ONE"], False),
        ({"venue": "PLOS ONE"}, [], False),
        ({"venue": "X"}, ["--"], True),  # a name of punctuation alone meets a missing journal
    ],
)
def test_exclusion(spark, columns, listed, want):
    names = ("venue", "journal", "journal_source", "doi", "doi_raw", "doi_url")
    row = spark.createDataFrame([tuple(columns.get(n) for n in names)], ", ".join(f"{n} string" for n in names))
    assert row.select(screening.is_excluded(listed)).first()[0] is want


def test_keywords_are_substrings_in_profile_order(spark):
    df = spark.createDataFrame([(0, "Storage of graphs", None)], "ord long, title string, abstract string")
    row = screening.with_keyword_tier(df, {"core": ["RAG"], "proxy": ["graphs", "graphs"], "eco": []}).first()
    assert (row.core_hits, row.keyword_tier, row.matched_keywords) == (["RAG"], "core", ["RAG", "graphs"])
    across = spark.createDataFrame([(0, "end", "start")], "ord long, title string, abstract string")
    assert screening.with_keyword_tier(across, {"eco": ["end start"]}).first().keyword_tier == "eco"


def test_alias_needs_more_than_three_letters(spark):
    df = spark.createDataFrame([("Proc. of KDD and ACL Anthology",)], "j string")
    assert not df.select(screening.matches_alias("j", F.array(F.lit("KDD")))).first()[0]
    assert df.select(screening.matches_alias("j", F.array(F.lit("KDD"), F.lit("anthology")))).first()[0]


def test_merge_takes_longest_abstract_and_first_filled(spark):
    rows = [("k", 0, "crossref", "", "", "A", None, 0), ("k", 1, "semantic_scholar", "long text", "s2", "B", "x", 3), ("k", 2, "crossref", "same text", "late", "C", "y", 4), ("one", 3, "a;b;a", "z", "", "", "", 0)]
    df = spark.createDataFrame(rows, "stable_id string, ord long, source string, abstract string, abstract_source string, title string, extra string, cites long")
    got = {r.stable_id: r for r in dedupe.merge_records(df).collect()}
    k = got["k"]
    assert (k.source, k.abstract, k.abstract_source, k.title, k.extra, k.cites) == ("crossref;semantic_scholar", "long text", "s2", "A", "x", 3)
    assert (got["one"].source, got["one"].cites, got["one"].title) == ("a;b", 0, "")


def test_merge_fills_abstract_source_from_later_records_only(spark):
    rows = [("k", 0, "a", "short", "early"), ("k", 1, "a", "the longest", ""), ("k", 2, "a", "", "later")]
    df = spark.createDataFrame(rows, "stable_id string, ord long, source string, abstract string, abstract_source string")
    assert dedupe.merge_records(df).first().abstract_source == "later"


def test_first_by_doi_keeps_blank_ones(spark):
    df = spark.createDataFrame([(0, "10.1/A"), (1, "https://doi.org/10.1/a"), (2, ""), (3, None)], "ord long, doi string")
    assert sorted(r.ord for r in dedupe.first_by_doi(df).collect()) == [0, 2, 3]


GOOD = {"relevance_score": 90, "research_track": "t", "priority": "A", "matched_topics": ["x"], "research_question": "", "method_summary": "", "main_contributions": [], "why_relevant": "", "methodological_value": "", "potential_use": "", "related_project": "", "recommended_action": "deep-read"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (json.dumps(GOOD), True),
        ("```json\n" + json.dumps(GOOD) + "\n```", True),
        (json.dumps(GOOD | {"relevance_score": True}), False),
        (json.dumps(GOOD | {"relevance_score": 90.5}), False),
        (json.dumps(GOOD | {"relevance_score": "90"}), False),
        (json.dumps(GOOD | {"relevance_score": 101}), False),
        (json.dumps(GOOD | {"relevance_score": 0, "priority": "B"}), False),
        (json.dumps(GOOD | {"priority": "urgent"}), False),
        (json.dumps(GOOD | {"method_summary": []}), False),
        (json.dumps(GOOD | {"main_contributions": [3]}), False),
        (json.dumps(GOOD | {"main_contributions": ["a", None]}), False),
        (json.dumps(GOOD | {"extra": ""}), False),
        (json.dumps({k: v for k, v in GOOD.items() if k != "priority"}), False),
        (json.dumps(GOOD | {"related_project": "other"}), False),
        ("{}", False),
        ("{" + "x" * 900, False),
        ("", False),
        (None, False),
    ],
)
def test_judgment_is_strict(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(judging.valid_judgment(F.col("raw"), ["mine"])).first()[0] is want


def test_capacity_orders_by_relevance_then_score_then_arrival(spark):
    rows = [(0, "A", 90, 0.1), (1, "A", 90, 0.9), (2, "A", 95, None), (3, "B", 70, None), (4, "D", 30, 1.0), (5, "A", 90, 0.9)]
    df = spark.createDataFrame(rows, "ord long, priority string, relevance_score int, semantic_score double")
    assert [r.ord for r in ranking.select_capacity(df, {"A": 3, "B": 1}, 25).collect()] == [2, 1, 5, 3]
    assert [r.ord for r in ranking.select_capacity(df, {"A": 3, "B": 1}, 2).collect()] == [2, 1]


def test_rank_is_stable_and_window_is_checked(spark):
    df = spark.createDataFrame([(0, None), (1, 0.5), (2, 0.5), (3, 0.9)], "ord long, semantic_score double")
    assert {r.ord: r.semantic_rank for r in ranking.with_semantic_rank(df).collect()} == {3: 1, 1: 2, 2: 3, 0: 4}
    assert ranking.window_bounds(None, "2026-09-03", 7, "x") == ("2026-08-27", "2026-09-03")
    with pytest.raises(ValueError, match="from_date"):
        ranking.window_bounds("2026-09-04", "2026-09-03", 7, "x")


def test_days_filter_passes_unreadable_dates(spark):
    df = spark.createDataFrame([("2026-09-01",), ("2026-09",), ("soon",), ("2026-10-01",), ("2026-01-01",)], "d string")
    near = ranking.within_days(F.col("d"), F.lit("2026-09-03").cast("date"), 7)
    assert [r.d for r in df.filter(near).collect()] == ["2026-09-01", "2026-09", "soon"]


def test_enrichment_fills_only_what_is_empty_and_only_the_last_of_a_doi(spark):
    papers = spark.createDataFrame([(0, "10.1/a", "", ""), (1, "10.1/A", "", ""), (2, "10.1/b", "own", "crossref"), (3, "", "", "")], "ord long, doi_raw string, abstract string, abstract_source string")
    works = spark.createDataFrame([("10.1/a", "A", "t", "", "", ["x"]), ("10.1/b", "B", "t2", "", "", [])], "doi string, abstract string, primary_topic string, topic_subfield string, topic_field string, all_topics array<string>")
    got = {r.ord: (r.abstract, r.abstract_source, r.primary_topic) for r in enrich(papers, works).collect()}
    assert got == {0: ("", "", None), 1: ("A", "openalex", "t"), 2: ("own", "crossref", "t2"), 3: ("", "", None)}


def test_upsert_acts_like_one_row_after_another(spark):
    old = spark.createDataFrame([("a", "t0", "1", "1", "read")], "key string, title string, first_seen string, last_seen string, reading_status string")
    batch = spark.createDataFrame([("a", "t1", "2", 0), ("b", "u1", "2", 1), ("b", "u2", "3", 2)], "key string, title string, seen_at string, ord long")
    got = {r.key: tuple(r)[1:6] for r in state.upsert(old, batch, ["key"], ["title"], {"reading_status": F.lit("new")}).collect()}
    assert got == {"a": ("t1", "1", "2", "read", False), "b": ("u2", "2", "3", "new", True)}


def test_feedback_is_validated_record_by_record(spark):
    papers = spark.createDataFrame([(1, "s1", "new"), (2, "s2", "new")], "id long, stable_id string, reading_status string")
    cols = "ord long, paper_id long, stable_id string, rating string, reading_status string, action string"
    rows = [(0, 1, None, "5", "reading", None), (1, None, "s2", "4.7", None, None), (2, 1, None, "6", None, None), (3, 1, None, None, "lost", None), (4, 9, None, None, None, None), (5, 1, None, "", "", "cited")]
    ok, bad = state.resolve_feedback(spark.createDataFrame(rows, cols), papers)
    assert sorted((r.ord, r.status, r.rating_value, r.resolved_id) for r in ok.collect()) == [(0, "reading", 5, 1), (1, "saved", 4, 2), (5, "cited", None, 1)]
    assert sorted(r.error for r in bad.collect()) == ["record 2: rating must be 1..5", "record 3: invalid reading_status: lost", "record 4: paper not found"]
    assert {r.id: r.reading_status for r in state.apply_feedback(papers, ok).collect()} == {1: "cited", 2: "saved"}


def test_semantic_items(spark):
    item = {"paperId": "p", "externalIds": {"DOI": "10.1000/S2.TEST", "ArXiv": "2609.00001"}, "title": " T ", "abstract": "a", "venue": "V", "year": 2026, "authors": [{"name": "N"}], "fieldsOfStudy": ["CS"], "s2FieldsOfStudy": [{"category": "CS"}, {"category": "Math"}]}
    df = spark.createDataFrame([(0, json.dumps(item), "q"), (1, json.dumps({"title": ""}), "q")], "ord long, item string, query string")
    rows = records.semantic_records(df).collect()
    assert len(rows) == 1
    assert (rows[0].doi, rows[0].arxiv_id, rows[0].subject, rows[0].title, rows[0].publication_date) == ("10.1000/s2.test", "2609.00001", ["CS", "Math"], "T", "2026")


def test_crossref_items(spark):
    item = {"title": ["A &amp; B"], "abstract": "<jats:p>Abstract Text</jats:p>", "published-online": {"date-parts": [[2026, 9]]}, "DOI": "10.1/X", "author": [{"given": "A", "family": "B"}] * 9, "container-title": [], "is-referenced-by-count": 3}
    notice = {"title": ["Erratum: something"], "created": {"date-parts": [[2026]]}}
    df = spark.createDataFrame([(0, json.dumps(item), ("J", None, "pool")), (1, json.dumps(notice), ("J", None, "pool"))], "ord long, item string, venue struct<journal: string, venue: string, pool: string>")
    r = records.crossref_records(df).collect()
    assert len(r) == 1
    assert (r[0].title, r[0].abstract, r[0].publication_date, r[0].journal, r[0].year, r[0].citation_count) == ("A & B", "Text", "2026-09", "J", 2026, 3)
    assert r[0].authors == "; ".join(["A B"] * 8) + " et al."


def test_pages_stop_at_the_cap_and_errors_stay_apart(spark):
    asked = []

    def fetch(url):
        asked.append(url)
        at = len(asked)
        return {"message": {"items": [{"n": i} for i in range(100)] if at < 4 else [], "next-cursor": f"c{at}"}}

    options = {"base_url": "x", "from_date": "a", "to_date": "b", "max_per_key": "150"}
    assert len(list(providers.crossref_pages({"issn": "1"}, options, fetch))) == 200  # the cap bounds the rows scanned, in whole pages
    assert "cursor=%2A" in asked[0] and "cursor=c1" in asked[1] and "issn%3A1%2Cfrom-pub-date%3Aa" in asked[0]
    asked.clear()
    assert len(list(providers.crossref_pages({"kind": "conference", "venue": "V"}, options | {"max_per_key": "1000"}, fetch))) == 300
    assert "query.container-title=V" in asked[0] and len(asked) == 4
    with pytest.raises(ZeroDivisionError):
        list(providers.crossref_pages({}, options, lambda url: 1 / 0))
    items, errors = providers.discover(spark, "crossref", [{"venue": "x"}, {"venue": "y"}], base_url="file:///nowhere", from_date="a", to_date="b", tries=1)
    assert items.count() == 0
    assert errors.count() == 2


def test_batches_of_dois_are_looked_up(spark):
    rows = spark.createDataFrame([(f"10.1/{i % 60}",) for i in range(130)] + [("",), (None,)], "doi_raw string").coalesce(1)
    batches = providers.doi_batches(rows.repartition(1))
    sizes = [len(json.loads(r.key)["dois"]) for r in batches.collect()]
    assert sum(sizes) == 60 and max(sizes) <= 50

    def fetch(url):
        if "10.1%2F7" in url:
            raise OSError("gone")
        return {"results": [{"doi": "10.1/x"}]}

    got = providers.look_up(batches, {"base_url": "x"}, fetch).collect()
    assert {r.error for r in got} >= {"OSError: gone"}


def test_requests_wait_as_told_and_give_up():
    import io
    import urllib.error

    class Answer(io.BytesIO):
        pass

    def failing(codes):
        left = list(codes)

        def open_url(request, timeout):
            if left:
                code, headers = left.pop(0)
                raise urllib.error.HTTPError(request.full_url, code, "x", headers, None) if code else OSError("net")
            return Answer(b'{"ok": 1}')

        return open_url

    waits = []
    client = http.Client(http.Patience(tries=4), wait=waits.append, open_url=failing([(429, {"Retry-After": "7"}), (503, {}), (0, {})]))
    assert client("u:x") == {"ok": 1}
    assert waits == [7.0, 2.0, 4.0]
    for codes in ([(404, {})], [(500, {})] * 2):
        with pytest.raises(urllib.error.HTTPError):
            http.Client(http.Patience(tries=2), wait=waits.append, open_url=failing(codes))("u:x", {"a": 1})
    with pytest.raises(ValueError, match="one try"):
        http.Patience(tries=0)


def test_profile_and_settings():
    text = "# P\n\n- **Profile name:** My Topic\n- **Weekly reading capacity:** 7 papers\n- **Max A:** 2\n\n## Research Description\n\nAbout it.\n\n## Core keywords\n\n- one\n* two\n\n## Proxy keywords\n\n- three\n"
    p = files.parse_profile(text)
    assert (p.name, p.description, p.keywords, p.weekly_capacity, p.caps) == ("my-topic", "About it.", {"core": ["one", "two"], "proxy": ["three"], "eco": []}, 7, {"A": 2, "B": 10, "C": 10})
    assert files.parse_project("# Proj\n\n## Research Question\n\nWhy?\n\n## Keywords\n\n- k\n").keywords == ["k"]
    assert files.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "c": 3}}) == {"a": {"b": 1, "c": 3}}
    assert providers.semantic_queries(None, "p", list("abcde")) == list("abcd")


def test_file_sources(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"profile": "p", "feedback": [{"paper_id": 1, "rating": 5}]}))
    (tmp_path / "g.json").write_text(json.dumps([{"stable_id": "s", "action": "read"}]))
    assert files.read_feedback(spark, str(tmp_path / "f.json")).first().rating == "5"
    assert files.read_feedback(spark, str(tmp_path / "g.json")).first().action == "read"
    (tmp_path / "s.json").write_text(json.dumps({"new": [{"title": "a"}], "already_seen": [{"title": "b"}]}))
    assert [r.title for r in files.read_snapshot(spark, str(tmp_path / "s.json"), "struct<title: string>").orderBy("ord").collect()] == ["a", "b"]
    (tmp_path / "v.json").write_text(json.dumps([{"journal": "J", "issn": "1", "pool": "x"}, {"venue": "V", "kind": "conference", "aliases": ["VV"], "pool": "y"}]))
    assert providers.in_pools(files.read_venues(spark, str(tmp_path / "v.json")), ["y"]).count() == 1


def test_run_is_incremental_and_reuses_judgments(spark, found):
    calls = []

    def judge(prompts):
        return pd.Series([json.dumps(GOOD)] * len(prompts))

    first = triage(found, PROFILE, Settings(model="m"), "2026-09-03", judge=judge)
    assert {r.is_new for r in first.state.collect()} == {True}
    assert {r.judge_checkpoint for r in first.candidates.collect()} == {"completed"}
    again = triage(found, PROFILE, Settings(model="m"), "2026-09-04", first.state.drop("is_new", "in_batch"), first.judgments, judge=judge)
    assert {r.is_new for r in again.state.collect()} == {False}
    assert {r.judge_checkpoint for r in again.candidates.collect()} == {"reused"}
    analysed = {r.stable_id: r for r in again.state.collect()}
    assert sorted(r.id for r in analysed.values()) == [1, 2, 3]
    assert {r.id for r in first.state.collect()} == {1, 2, 3}
    assert {r.keyword_tier for r in analysed.values()} == {"core", "proxy", "eco"}
    assert {r.relevance_score for r in analysed.values()} == {GOOD["relevance_score"]}
    for changed in (Settings(model="m", temperature=0.2), Settings(model="m", api_base="u"), Settings(model="m", projects=[files.Project("P", {"research question": "Why?"}, [])])):
        more = triage(found, PROFILE, changed, "2026-09-04", judgments=first.judgments, judge=judge)
        assert {r.judge_checkpoint for r in more.candidates.collect()} == {"completed"}
    other = triage(found, PROFILE, Settings(model="m2"), "2026-09-04", judgments=first.judgments, judge=lambda p: pd.Series(["bad"] * len(p)))
    assert {r.judge_checkpoint for r in other.candidates.collect()} == {"failed-fallback"}
    assert sorted(r.priority for r in other.queue.collect()) == ["A", "B", "C"]
    assert calls == []


def test_run_without_judge_and_with_embeddings(spark, found):
    run = triage(found, PROFILE, Settings(excluded=["Scientometrics"], embedding=True), "now", encode=lambda t: pd.Series([[1.0, 0.0]] * len(t)), query_vector=[1.0, 0.0])
    rows = {r.ord: r for r in run.candidates.collect()}
    assert set(rows) == {0, 2}
    assert (rows[0].priority, rows[0].semantic_score, rows[0].semantic_rank, rows[0].judge_checkpoint) == ("A", 1.0, 1, "disabled")
    assert run.stats.first().count_a == 1


def test_translation_protects_terms(spark):
    df = spark.createDataFrame([("A knowledge graph", "x", "")], "title string, abstract string, title_cn string")
    row = translate(df, lambda s: s.str.upper()).first()
    assert (row.title_cn, row.abstract_cn) == ("A 知识图谱", "X")


def test_sinks(spark, found, tmp_path):
    run = triage(found, PROFILE, Settings(), "now")
    page = "".join(outputs.report(run.candidates, "R", {"A": 1}))
    assert page.count("<article") == 3
    assert "|" in outputs.preview(run.queue, {"A": 1})
    assert outputs.workbook(run.candidates, {"A": 1})[:2] == b"PK"
    with pytest.MonkeyPatch.context() as m:
        m.setattr(outputs, "MOST_OPENED", 2)
        with pytest.raises(ValueError, match="write sheets"):
            outputs.workbook(run.candidates, {})
    assert "</script>" not in outputs.app(run.candidates, "kg", {}).split("id=data>")[1].split("</script>")[0]
    outputs.write_notes(run.queue, str(tmp_path / "n"))
    outputs.write_sheets(run.candidates, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "n/notes")).count() > 3
    assert outputs.snapshot(run.candidates, str(tmp_path), "kg", "2026-09-03", "judged").endswith("judged")


def test_versions_and_stream(spark, tmp_path):
    spark.createDataFrame([("a", "t1", "2", 0), ("b", "u1", "2", 1)], "key string, title string, seen_at string, ord long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, title string, seen_at string, ord long").parquet(str(tmp_path / "in"))
    schema = "key string, title string, first_seen string, last_seen string, reading_status string"
    for _ in range(2):
        q = stream_upserts(stream, str(tmp_path / "state"), "papers", schema, ["key"], ["title"], {"reading_status": F.lit("new")}, str(tmp_path / "cp"))
        q.awaitTermination(60)
    rows, version = state.read_version(spark, str(tmp_path / "state"), "papers")
    assert version >= 1
    assert sorted(r.key for r in rows.collect()) == ["a", "b"]


def test_judges_are_asked_again_and_models_keep_order(spark):
    def post(url, payload):
        if url.endswith("embeddings"):
            return {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}
        turns = payload["messages"]
        assert turns[0]["role"] == "system"
        if turns[1]["content"] == "good":
            return {"choices": [{"message": {"content": json.dumps(GOOD) if len(turns) > 3 else "no"}}]}
        return {"choices": [{"message": {"content": f"bad {len(turns)}"}}]}

    todo = spark.createDataFrame([("good",), ("worse",)], "p string")
    got = {r.p: r for r in judging.judge_todo(todo, models.chat_judge("b", "m", post), F.col("p")).collect()}
    assert (got["good"].status, got["good"].raw_response) == ("complete", json.dumps(GOOD))
    assert (got["worse"].status, json.loads(got["worse"].raw_response)) == ("failed", ["bad 2", "bad 4"])
    lost = judging.judge_todo(todo, models.chat_judge("b", "m", lambda u, p: 1 / 0), F.col("p"), attempts=1).first()
    assert json.loads(lost.raw_response) == ["error: ZeroDivisionError"]
    assert models.encoder("b", "m", post)(pd.Series(["s", "t", "u"])).tolist() == [[1.0], [2.0], None]
    assert models.chat_translator("b", "m", lambda u, p: 1 / 0)(pd.Series(["a", None])).tolist() == ["", ""]


def test_a_lost_pointer_is_written_again_and_old_versions_go(spark, tmp_path):
    root = str(tmp_path)
    for v in range(1, 6):
        state.write_version(spark.range(v), root, "t", v)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v=3", "v=4", "v=5"]
    spark.range(99).write.parquet(f"{root}/t/v=6")  # an attempt that died before its pointer
    assert state.read_version(spark, root, "t")[1] == 5
    state.write_version(spark.range(6), root, "t", 6)
    assert state.read_version(spark, root, "t")[0].count() == 6
    with pytest.raises(ValueError, match="exists"):
        state.write_version(spark.range(1), root, "t", 6)
    with pytest.raises(FileNotFoundError):
        state.read_version(spark, root, "none")


def test_a_stream_batch_that_died_halfway_runs_again(spark, tmp_path):
    spark.createDataFrame([("a", "t1", "2", 0)], "key string, title string, seen_at string, ord long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, title string, seen_at string, ord long").parquet(str(tmp_path / "in"))
    spark.range(3).write.parquet(str(tmp_path / "state/papers/v=1"))
    schema = "key string, title string, first_seen string, last_seen string, reading_status string"
    stream_upserts(stream, str(tmp_path / "state"), "papers", schema, ["key"], ["title"], {"reading_status": F.lit("new")}, str(tmp_path / "cp")).awaitTermination(60)
    rows, version = state.read_version(spark, str(tmp_path / "state"), "papers")
    assert (version, [r.key for r in rows.collect()]) == (1, ["a"])


def test_a_frequent_doi_is_enriched_once(spark):
    rows = spark.createDataFrame([(i, "10.1/X", "", "") for i in range(50)] + [(50, "", "", ""), (51, "10.2/y", "own", "c")], "ord long, doi_raw string, abstract string, abstract_source string")
    works = spark.createDataFrame([("10.1/x", "found", "t", "s", "f", ["t"]), ("10.2/y", "no", "t2", "s", "f", [])], "doi string, abstract string, primary_topic string, topic_subfield string, topic_field string, all_topics array<string>")
    got = {r.ord: r for r in enrich(rows, works).collect()}
    assert [i for i, r in got.items() if r.abstract == "found"] == [49]
    assert (got[51].abstract, got[51].primary_topic, got[50].primary_topic, len(got)) == ("own", "t2", None, 52)


def test_few_files_are_dealt_and_many_stay(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    sizes = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert sizes(scratch.spread(one)) == spark.sparkContext.defaultParallelism
    assert scratch.spread(many) is many
    made = spark.range(3)
    assert scratch.spread(made) is made
    kept = scratch.store(made, "few")
    file = kept.inputFiles()[0]
    assert scratch.exists(spark, file)
    scratch.drop_stored(kept)
    assert not scratch.exists(spark, file)


def test_conferences_bring_only_their_own_proceedings(spark, monkeypatch):
    items = [{"title": [f"Paper {i}"], "container-title": [c], "DOI": f"10.1/{i}"} for i, c in enumerate(["Proceedings of the Web Conference", "Unrelated", "the web conference 2", "Web Conference"])]
    rows = [("crossref", json.dumps({"kind": "conference", "venue": "Web Conference", "aliases": ["WWW"], "pool": "p"}, sort_keys=True), i, json.dumps(x)) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "provider string, key string, row_ord long, item string")
    monkeypatch.setattr(providers, "discover", lambda *a, **k: (df, df.limit(0)))
    venues = spark.createDataFrame([("conference",)], "kind string")
    found, _ = cli.crossref(spark, venues, "a", "b", 2)
    assert [r.title for r in found.orderBy("ord").collect()] == ["Paper 0", "Paper 2"]


def test_command_line(spark, found, tmp_path, capsys):
    (tmp_path / "profile-kg.md").write_text("# P\n\n## Core keywords\n\n- scientific knowledge graph\n")
    found.write.parquet(str(tmp_path / "found"))
    base = ["--profile", str(tmp_path / "profile-kg.md"), "--out", str(tmp_path / "out"), "--records", str(tmp_path / "found")]
    assert cli.main(["triage", *base, "--to-date", "2026-09-03"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["stats"]["count_a"] == 1
    ledger = state.runs(spark, str(tmp_path / "out/runs")).collect()
    assert [(r.run_id, r.to_date, r.finished_at is not None) for r in ledger] == [(out["run_id"], "2026-09-03", True)]
    assert cli.main(["triage", *base, "--from-date", "2026-09-04", "--to-date", "2026-09-03"]) == 2
    assert cli.main(["screen", *base[:2], "--records", str(tmp_path / "found"), "--out", str(tmp_path / "tiers")]) == 0
    found.write.parquet(str(tmp_path / "later"))
    capsys.readouterr()
    assert cli.main(["triage", *base[:4], "--records", str(tmp_path / "later"), "--to-date", "2026-09-04", "--outputs", "notes", "html", "excel", "app", "sheets"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert len(out["written"]) == 5
    papers, version = state.read_version(spark, str(tmp_path / "out/state"), "papers")
    assert version == 2 and papers.count() == 3
    note = "\n".join(r.value for r in spark.read.option("recursiveFileLookup", True).text(out["written"][0], wholetext=True).filter("value LIKE '---%'").collect())
    assert "## Main Contributions" in note and "## Abstract EN" in note
    assert (tmp_path / "out" / out["run_id"] / "notes/_index.csv").read_text().startswith("\ufeffpaper_id,priority")
    judged = f"{base[3]}/profile=kg/to_date=2026-09-04/judged-{out['run_id']}"
    assert cli.main(["render", "--judged", judged, "--out", str(tmp_path / "again"), "--outputs", "html"]) == 0
    scanned = f"{base[3]}/profile=kg/to_date=2026-09-04/scan-{out['run_id']}"
    capsys.readouterr()
    for flag in ("--scan", "--screened"):
        assert cli.main(["triage", *base[:4], flag, scanned, "--to-date", "2026-09-05", "--outputs"]) == 0
        assert json.loads(capsys.readouterr().out)["stats"]["count_a"] == 1
    (tmp_path / "set.json").write_text(json.dumps({"profile": "profile-kg.md", "out": "out3", "records": "found", "to-date": "2026-09-03", "caps": {"A": 0, "B": None}, "outputs": []}))
    assert cli.main(["triage", "--config", str(tmp_path / "set.json")]) == 0
    assert json.loads(capsys.readouterr().out)["stats"]["count_a"] == 0
    assert cli.main(["triage", "--config", str(tmp_path / "set.json"), "--records", str(tmp_path / "later"), "--from-date", "2027-01-01"]) == 2
    (tmp_path / "bad.json").write_text('{"nothing": 1}')
    assert cli.main(["triage", "--config", str(tmp_path / "bad.json")]) == 2
    assert cli.main(["feedback", "--state", "x"]) == 2
    assert json.loads(capsys.readouterr().err.splitlines()[-1]) == {"error": "missing: feedback"}
    ids = {r.stable_id: r.id for r in papers.collect()}
    first = next(iter(ids))
    (tmp_path / "f.json").write_text(json.dumps([{"stable_id": first, "action": "read", "rating": 4}, {"stable_id": "s9"}, {"paper_id": 77}]))
    assert cli.main(["feedback", "--feedback", str(tmp_path / "f.json"), "--state", str(tmp_path / "out/state")]) == 1
    assert json.loads(capsys.readouterr().out) == {"imported": 1, "errors": ["record 1: paper not found", "record 2: paper not found"]}
    after, _ = state.read_version(spark, str(tmp_path / "out/state"), "papers")
    assert {r.stable_id: r.reading_status for r in after.collect()}[first] == "read"
    assert state.read_version(spark, str(tmp_path / "out/state"), "feedback")[0].first().paper_id == ids[first]
