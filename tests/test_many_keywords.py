"""Many keywords, totals by field, notes as files, versions of older schemas."""

import csv
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryflow.functions import scratch
from quarryflow.operators import keyword_index, screening, state
from quarryflow.plans import outputs
from quarryflow.plans.triage import STATE_SCHEMA, STATE_STEPS
from quarryflow.sources import file_sink, models


def texts(spark, seed, n):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("abcdeé ß") for _ in range(r.randint(0, 300))).title()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "ord long, title string").withColumn("abstract", F.lit("tail")), rows


def test_ten_thousand_keywords_equal_plain_search(spark):
    r = random.Random(1)
    keywords = {t: ["".join(r.choice("ABcdeé ß") for _ in range(r.randint(1, 7))) for _ in range(3400)] for t in screening.TIERS}
    keywords["eco"] += ["", keywords["eco"][0]]
    df, rows = texts(spark, 2, 60)
    got = {x.ord: x for x in screening.with_keyword_tier(df, keywords).collect()}
    for i, t in [*rows, (60, None), (61, "")]:
        hay = f"{t or ''} tail ".lower()
        want = {tier: [k for k in ks if k.lower() in hay] for tier, ks in keywords.items()}
        assert {t: got[i][f"{t}_hits"] for t in screening.TIERS} == want
        assert got[i].keyword_tier == next((t for t in screening.TIERS if want[t]), "other")
        assert got[i].matched_keywords == list(dict.fromkeys(k for t in screening.TIERS for k in want[t]))


def test_literals_and_automaton_agree(spark, monkeypatch):
    r = random.Random(3)
    keywords = {t: ["".join(r.choice("abcdE") for _ in range(r.randint(1, 4))) for _ in range(30)] for t in ("core", "eco")}
    df, _ = texts(spark, 4, 40)
    found = []
    for most in (0, 10**6):
        monkeypatch.setattr(screening, "LITERALS", most)
        found.append(sorted(map(repr, screening.with_keyword_tier(df, keywords).collect())))
    assert found[0] == found[1]
    monkeypatch.setattr(screening, "LITERALS", 0)
    monkeypatch.setattr(keyword_index, "available", lambda: False)
    assert sorted(map(repr, screening.with_keyword_tier(df, keywords).collect())) == found[0]


def test_notes_are_files_and_come_all_at_once(spark, tmp_path):
    columns = "ord long, paper_id long, priority string, relevance_score int, publication_date string, title string, abstract string, doi_url string, main_contributions array<string>"
    rows = [(0, 7, "A", 90, "2026-01-02", 'A "quoted", title', "x", "https://doi.org/1", ["one", "two"]), (1, 8, "B", 70, None, "Other", None, None, None), (2, 9, "Ignore", 0, "2026", "No", None, None, None), (3, 10, "B", 71, "", "other", "later", None, [])]
    df = spark.createDataFrame(rows, columns)
    outputs.write_note_files(df, str(tmp_path / "notes"))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["notes/A/2026-01-02_a-quoted-title.md", "notes/B/nodate_other.md", "notes/_index.csv"]
    note = (tmp_path / "notes/A/2026-01-02_a-quoted-title.md").read_text()
    assert 'doi: "https://doi.org/1"' in note and "relevance_score: 90\n" in note and "- one\n- two" in note
    assert "later" in (tmp_path / "notes/B/nodate_other.md").read_text()
    with (tmp_path / "notes/_index.csv").open(encoding="utf-8-sig", newline="") as f:
        assert {r["paper_id"]: r["title"] for r in csv.DictReader(f)} == {"7": 'A "quoted", title', "8": "Other", "10": "other"}
    with pytest.raises(FileExistsError):
        outputs.write_note_files(df, str(tmp_path / "notes"))
    bad = spark.range(4).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") < 3, "x").otherwise(F.raise_error(F.lit("gone"))).alias("body"))
    with pytest.raises(Exception, match="gone"):
        file_sink.write_files(bad, str(tmp_path / "more"))
    # a task that is still at work when the job is given up may leave a hidden folder
    assert [p.name for p in tmp_path.iterdir() if p.name[0] != "_"] == ["notes"]


def test_older_versions_are_migrated(spark, tmp_path):
    old = spark.createDataFrame([(1, "kg", "s1", "", "t", "a", "2020", "v", "src", "f", "l", 80, "A", "x")], "id int, profile string, stable_id string, doi string, title string, abstract string, publication_date string, venue string, source string, first_seen string, last_seen string, relevance_score int, priority string, own string")
    state.write_version(old, str(tmp_path), "papers", 1)
    now, version = state.read_or_empty(spark, str(tmp_path), "papers", STATE_SCHEMA, STATE_STEPS)
    assert version == 1 and now.columns == [*spark.createDataFrame([], STATE_SCHEMA).columns, "own"]
    row = now.first()
    assert (row.related_project, row.reading_status, row.semantic_score, row.relevance_score, row.own) == ("", "new", None, 80, "x")
    batch = spark.createDataFrame([("kg", "s1", "t2", "9", 0), ("kg", "s2", "u", "9", 1)], "profile string, stable_id string, title string, seen_at string, ord long")
    after = state.upsert(now, batch, ["profile", "stable_id"], ["title"], {"reading_status": F.lit("new")}).drop("is_new", "in_batch")
    state.write_version(after, str(tmp_path), "papers", 2)
    again, _ = state.read_or_empty(spark, str(tmp_path), "papers", STATE_SCHEMA, STATE_STEPS)
    assert {r.stable_id: (r.title, r.related_project) for r in again.collect()} == {"s1": ("t2", ""), "s2": ("u", None)}


def test_embeddings_are_asked_for_in_portions():
    sizes = []

    def post(url, payload):
        sizes.append(len(payload["input"]))
        if "bad" in payload["input"]:
            raise OSError
        return {"data": [{"index": i, "embedding": [len(t)]} for i, t in reversed(list(enumerate(payload["input"])))]}

    got = models.encoder("b", "m", post, most=4)(pd.Series(["a", "bb", "c", "d", "bad", "e", "f", "g", "hhh"], index=range(5, 14)))
    assert sizes == [4, 4, 1]
    assert got.tolist() == [[1.0], [2.0], [1.0], [1.0], None, None, None, None, [3.0]]
    assert models.encoder("b", "m", post)(pd.Series([], dtype=object)).empty


def test_files_go_where_spark_writes(spark, tmp_path):
    for text in ("one", "two"):
        scratch.write_file(spark, f"file://{tmp_path}/sub/x.html", [text.encode(), "é".encode()])
    assert (tmp_path / "sub" / "x.html").read_text() == "twoé"
