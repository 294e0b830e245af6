"""Judgments that outlive a run: the log of answers, killed runs, repeated tasks, reminders."""

import contextlib
import io
import json
import os
import re
import uuid
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarryflow.operators import judging, judgment_log
from quarryflow.operators.judgment_log import _answered_before, _put_down, fold_log, judge_durably, judgments_of, read_log

GOOD = json.dumps({f: [] if f in judging.LIST_FIELDS else "" for f in judging.FIELDS} | {"relevance_score": 90, "priority": "A", "recommended_action": "save"})


def demand(spark, n, start=0):
    return spark.createDataFrame([(f"s{i}", "c", "m", f"text {i}") for i in range(start, n)], "stable_id string, context_hash string, model string, title string")


def recording(folder, answer, die_after=None):
    """A judge that notes each record it is asked about; it kills its process once so many are noted."""

    def judge(conversations):
        out = []
        for c in conversations:
            if die_after is not None and len(list(Path(folder).iterdir())) >= die_after:
                os._exit(17)
            turns = json.loads(c)
            (Path(folder) / uuid.uuid4().hex).write_text(turns[0]["content"])
            out.append(answer(turns))
        return pd.Series(out)

    return judge


def asked(folder):
    return sorted(p.read_text() for p in Path(folder).iterdir())


def test_a_killed_run_loses_no_answer(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    log = str(tmp_path / "log")
    rows = demand(spark, 60)
    with pytest.raises(Exception, match="(?s).*"):
        judge_durably(rows, recording(first, lambda t: GOOD, 25), F.col("title"), log, "r1", portion=1, lanes=2, tasks=4)
    answered = {r.stable_id for r in read_log(spark, log).collect()}
    assert 15 <= len(answered) <= 30
    done = judge_durably(rows, recording(second, lambda t: GOOD), F.col("title"), log, "r2", portion=4).collect()
    assert not answered & {"s" + t.split()[1] for t in asked(second)}
    assert len(asked(second)) == 60 - len(answered)
    assert {r.stable_id for r in done if r.judge_checkpoint == "reused"} == answered
    assert {r.status for r in done} == {"complete"} and len(done) == 60
    third = judge_durably(rows, recording(second, lambda t: "never asked"), F.col("title"), log, "r3").collect()
    assert len(asked(second)) == 60 - len(answered) and {r.judge_checkpoint for r in third} == {"reused"}


def test_unsound_answers_are_asked_again_with_a_reminder_and_failed_ones_in_the_next_run(spark, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()

    def answer(turns):
        n = int(turns[0]["content"].split()[1])
        return GOOD if n % 3 == 0 or n % 3 == 1 and len(turns) == 3 else None if n == 2 else f"no {len(turns)}"

    got = {r.stable_id: r for r in judge_durably(demand(spark, 9), recording(folder, answer), F.col("title"), str(tmp_path / "log"), "a").collect()}
    assert [got[f"s{i}"].status for i in range(6)] == ["complete", "complete", "failed"] * 2
    assert json.loads(got["s5"].raw_response) == ["no 1", "no 3"] and json.loads(got["s2"].raw_response) == ["", ""]
    assert got["s5"].judge_checkpoint == "failed-fallback"
    assert len(asked(folder)) == 3 + 6 + 6
    again = {r.stable_id: r for r in judge_durably(demand(spark, 9), recording(folder, lambda t: GOOD), F.col("title"), str(tmp_path / "log"), "b").collect()}
    assert {s for s, r in again.items() if r.judge_checkpoint == "completed"} == {"s2", "s5", "s8"}
    table = {r.stable_id: r for r in judgments_of(read_log(spark, str(tmp_path / "log")), "b").collect()}
    assert len(table) == 9 and {r.status for r in table.values()} == {"complete"}


def test_a_repeated_task_skips_what_it_put_down(tmp_path):
    folder = f"file://{tmp_path}/part=0"
    assert _answered_before(folder, ["stable_id"]) == set()
    _put_down(folder, [{"stable_id": "ä", "answer": None}, {"stable_id": "b", "answer": "x\ny"}])
    (tmp_path / "part=0" / "_half.json").write_text('{"stable_id": "c"')  # a portion whose task died
    assert _answered_before(folder, ["stable_id"]) == {("ä",), ("b",)}


def test_an_empty_demand_and_answers_given_twice(spark, tmp_path):
    assert judge_durably(demand(spark, 1).limit(0), lambda c: 1 / 0, F.col("title"), str(tmp_path / "log"), "r").count() == 0
    rows = [("s", "c", "m", "r", 1, "no"), ("s", "c", "m", "r", 1, "nope"), ("s", "c", "m", "r", 2, None), ("t", "c", "m", "q", 1, GOOD), ("t", "c", "m", "r", 1, GOOD)]
    log = spark.createDataFrame(rows, "stable_id string, context_hash string, model string, run string, attempt int, answer string")
    got = {r.stable_id: r for r in fold_log(log, "r").collect()}
    assert got["s"].found is None and got["s"].tries == ["no", ""]
    assert got["t"].found.run == "r"


def test_a_run_reads_what_others_answered_once(spark, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(judgment_log, "read_log", lambda s, folder, *a: (read.append(folder.rpartition("/log")[2]), read_log(s, folder, *a))[1])
    log, folder = str(tmp_path / "log"), tmp_path / "asked"
    folder.mkdir()
    judge_durably(demand(spark, 4), recording(folder, lambda t: GOOD), F.col("title"), log, "a")
    read.clear()
    # s7 needs a second answer, s8 gets no sound one
    answer = lambda t: "no" if t[0]["content"] == "text 8" or t[0]["content"] == "text 7" and len(t) == 1 else GOOD
    got = {r.stable_id: r for r in judge_durably(demand(spark, 9), recording(folder, answer), F.col("title"), log, "b").collect()}
    assert read == ["", "/run=b", "/run=b"]
    assert [got[f"s{i}"].judge_checkpoint for i in range(9)] == ["reused"] * 4 + ["completed"] * 4 + ["failed-fallback"]
    assert json.loads(got["s8"].raw_response) == ["no", "no"] and got["s7"].raw_response == GOOD
    assert asked(folder) == sorted([f"text {i}" for i in range(9)] + ["text 7", "text 8"])


def test_an_answer_is_parsed_once(spark):
    answers = spark.range(1).select(F.concat(F.lit(GOOD), F.col("id")).alias("a"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        answers.select(judging.valid_judgment(F.col("a"), [])).explain()
    assert len(re.findall("parseJson", out.getvalue())) == 1, out.getvalue()
