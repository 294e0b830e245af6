"""What a scan takes in, and which part of a snapshot is screened."""

import json
import subprocess
from shutil import which

import pytest

from quarryflow import cli
from quarryflow.plans import outputs
from quarryflow.sources import files


def test_pools_leave_conferences_out_and_scans_skip_journals_without_issn(spark, tmp_path):
    venues = [{"journal": "J", "issn": "1", "pool": "x"}, {"journal": "K", "issn": " ", "pool": "x"}, {"journal": "L", "pool": "y"}, {"venue": "V", "kind": "conference", "pool": "x"}]
    (tmp_path / "v.json").write_text(json.dumps(venues))
    names = lambda *a: sorted(r.journal or r.venue for r in cli.watched(spark, [str(tmp_path / "v.json")], *a).collect())
    assert names([]) == ["J", "K", "L", "V"]
    assert names(["x"]) == ["J", "K"]
    assert names([], True) == ["J", "V"]
    assert names(["x", "y"], True) == ["J"]


def test_a_scan_knows_records_by_doi_alone(spark, monkeypatch):
    items = [("10.1/a", "Same"), ("10.1/A", "Same"), ("", "Same"), ("", "Same")]
    rows = [("crossref", json.dumps({"journal": "J"}), i, json.dumps({"title": [t], "DOI": d})) for i, (d, t) in enumerate(items)]
    df = spark.createDataFrame(rows, "provider string, key string, row_ord long, item string")
    monkeypatch.setattr(cli.providers, "discover", lambda *a, **k: (df, df.limit(0)))
    venues = spark.createDataFrame([("journal",)], "kind string")
    assert cli.crossref(spark, venues, "a", "b", 9, by_doi=True)[0].count() == 3
    assert cli.crossref(spark, venues, "a", "b", 9)[0].count() == 2


@pytest.mark.parametrize(("field", "want"), [("both", {"a", "b", "c"}), ("new", {"a"}), ("already_seen", {"b", "c"})])
def test_snapshots_of_new_and_seen_records(spark, tmp_path, field, want):
    record = lambda t: {"title": t, "ord": 7, "doi": ""}
    (tmp_path / "scan.json").write_text(json.dumps({"new": [record("a")], "already_seen": [record("b"), record("c")], "coverage": {}}))
    got = files.read_scan(spark, str(tmp_path / "scan.json"), cli.RECORD, field)
    assert {r.title for r in got.collect()} == want and "ord" in got.columns
    assert len({r.ord for r in got.collect()}) == len(want)
    lines = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "title string, is_new boolean")
    lines.write.json(str(tmp_path / "lines"))
    assert {r.title for r in files.read_scan(spark, str(tmp_path / "lines"), cli.RECORD, field).collect()} == want


def test_screening_a_part_of_a_snapshot(spark, tmp_path, capsys):
    (tmp_path / "profile-kg.md").write_text("# P\n\n## Core keywords\n\n- graph\n")
    (tmp_path / "scan.json").write_text(json.dumps({"new": [{"title": "A graph"}, {"title": "none"}], "already_seen": [{"title": "Graphs"}]}))
    base = ["screen", "--profile", str(tmp_path / "profile-kg.md"), "--scan", str(tmp_path / "scan.json")]
    for field, want in (("new", {"core": 1, "other": 1}), ("both", {"core": 2, "other": 1})):
        assert cli.main([*base, "--field", field, "--out", str(tmp_path / field)]) == 0
        assert json.loads(capsys.readouterr().out) == want
    assert cli.main(["screen", *base[1:3], "--out", str(tmp_path / "x")]) == 2
    assert cli.main(["triage", *base[1:], "--out", str(tmp_path / "out"), "--to-date", "2026-01-01", "--outputs"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["stats"]["count_a"] == 2


def test_pages_have_controls_and_sound_scripts(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "s", "T", "abs", "V", "2026-01-01", "", "A", 90)], "ord long, id long, stable_id string, title string, abstract string, venue string, publication_date string, doi string, priority string, relevance_score int")
    rows = rows.selectExpr("*", "'crossref' AS source", "doi AS doi_url", "0D AS semantic_score")
    page = "".join(outputs.report(rows, "R", {}))
    assert 'data-venue="V"' in page and 'data-source="crossref"' in page and "id=days" in page
    app = outputs.app(rows, "kg", {})
    assert "id=find" in app and '"cited"' in app and "reading_status" in app
    if which("node"):
        for i, text in enumerate((page, app)):
            (tmp_path / f"{i}.js").write_text(text.rsplit("<script>", 1)[1].split("</script>")[0])
            subprocess.run(["node", "--check", str(tmp_path / f"{i}.js")], check=True)
