"""A durable log of a judge's answers, so that no answered record is asked about again.

A judge is slow and paid for, hence its answers must not wait for the end of a
run. `judge_durably` hands the open records to a Spark data source whose writer
asks the judge inside each task, some portions side by side, and puts every
portion down as a file of its own as soon as it is answered: written under a
hidden name, then renamed. Whatever kills a run, the answers that came before
are in the log, and the next run asks for the rest. A task that Spark repeats
skips what its earlier attempt put down.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.scratch import exists, qualified, store
from ..sources.page_log import file_system, put_down
from .judging import conversation, valid_judgment

Judge = Callable[[pd.Series], pd.Series]
KEYS = ("stable_id", "context_hash", "model")


@dataclass
class _Answered(WriterCommitMessage):
    count: int


def _put_down(folder: str, rows: list[dict[str, Any]]) -> None:
    """One file of JSON lines, complete or not there."""
    put_down(folder, f"{uuid.uuid4().hex}.json", "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


def _answered_before(folder: str, keys: list[str]) -> set[tuple]:
    """What an earlier attempt of this task put down."""
    from pyarrow.fs import FileSelector

    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    found = set()
    for info in files.get_file_info(FileSelector(path)):
        if info.base_name.endswith(".json") and not info.base_name.startswith("_"):
            with files.open_input_stream(info.path) as f:
                found |= {tuple(json.loads(line)[k] for k in keys) for line in f.read().decode().splitlines()}
    return found


class _Asker(DataSourceWriter):
    def __init__(self, options: dict[str, str], judge: Judge):
        self.options, self.judge = dict(options), judge

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        keys = self.options["keys"].split(",")
        portion, lanes = int(self.options["portion"]), int(self.options["lanes"])
        folder = f"{self.options['folder']}/part={TaskContext.get().partitionId()}"
        have = _answered_before(folder, keys)
        rows = (r for r in iterator if tuple(r[k] for k in keys) not in have)

        def ask(some: list[Row]) -> int:
            answers = self.judge(pd.Series([r["conversation"] for r in some]))
            put = [{**{k: r[k] for k in keys}, "run": r["run"], "attempt": r["attempt"], "answer": None if pd.isna(a) else a} for r, a in zip(some, answers, strict=True)]
            _put_down(folder, put)
            return len(put)

        count = 0
        with ThreadPoolExecutor(lanes) as pool:
            waiting = set()
            while some := list(islice(rows, portion)):
                waiting.add(pool.submit(ask, some))
                if len(waiting) == lanes:
                    done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                    count += sum(d.result() for d in done)
            count += sum(w.result() for w in waiting)
        return _Answered(count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing is left to do: each portion was put down when it came."""

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What was answered stays, which is what the log is for."""


def _source(judge: Judge) -> type[DataSource]:
    class JudgmentLog(DataSource):
        """Options: folder, keys, portion (records a request of the judge and a file), lanes (portions that a task has asked for at once)."""

        @classmethod
        def name(cls) -> str:
            return "judgment_log"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Asker(self.options, judge)

    return JudgmentLog


def read_log(spark: SparkSession, folder: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, run, attempt, answer of all that was ever answered; a table without rows if nothing was."""
    schema = ", ".join([*(f"{k} string" for k in keys), "run string, attempt int, answer string"])
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folder)


def fold_log(log: DataFrame, run: str, keys: tuple[str, ...] = KEYS, projects: list[str] | None = None) -> DataFrame:
    """keys, found (run and answer of the first sound answer, null if there is none), tries (this run's answers in order) of each key."""
    sound = valid_judgment(F.col("answer"), projects)
    marked = log.withColumn("answer", F.coalesce("answer", F.lit(""))).select("*", F.when(sound, F.struct(F.col("run") != run, "attempt", "run", "answer")).alias("sound"))
    # an attempt that a lost executor repeated may have two answers; one counts
    tries = F.array_sort(F.collect_list(F.when(F.col("run") == run, F.struct("attempt", "answer"))))
    folded = marked.groupBy(*keys).agg(F.min("sound").alias("sound"), tries.alias("t"))
    once = F.filter("t", lambda x, i: (i == 0) | (x["attempt"] != F.get("t", F.greatest(i - 1, F.lit(0)))["attempt"]))
    return folded.select(*keys, F.when(F.col("sound").isNotNull(), F.struct("sound.run", "sound.answer")).alias("found"), F.transform(once, lambda x: x["answer"]).alias("tries"))


def judge_durably(
    demand: DataFrame, judge: Judge, prompt: Column, folder: str, run: str, keys: tuple[str, ...] = KEYS, projects: list[str] | None = None,
    attempts: int = 2, portion: int = 8, lanes: int = 4, tasks: int | None = None,
) -> DataFrame:
    """demand with raw_response, status (complete or failed) and judge_checkpoint (reused, completed or failed-fallback), answers logged below `folder`.

    demand has one row for each key. A record with a sound answer in the log, of
    whatever run, is not asked about. One whose answer is no judgment is asked
    again with a reminder, `attempts` times a run; records that failed in an
    earlier run are tried anew.
    """
    spark = demand.sparkSession
    root = qualified(spark, folder)
    demand = store(demand, "judge-demand")
    spark.dataSource.register(_source(judge))
    none = F.array().cast("array<string>")

    def folded(part: str, name: str) -> DataFrame:
        return store(fold_log(read_log(spark, part, keys), run, keys, projects), name)

    # what other runs answered is read once; after an attempt this run's answers alone are read
    before = folded(folder, "judge-before")
    state = demand.join(before, list(keys), "left")
    for attempt in range(1, attempts + 1):
        open_ = state.filter(F.col("found").isNull() & (F.coalesce(F.size("tries"), F.lit(0)) < attempt))
        asked = open_.select(*keys, F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), conversation(prompt, F.coalesce("tries", none)).alias("conversation"))
        asked = store(asked.repartition(tasks or spark.sparkContext.defaultParallelism, *keys), "judge-asked")
        if asked.isEmpty():
            break
        options = {"folder": f"{root}/run={run}/attempt={attempt}", "keys": ",".join(keys), "portion": portion, "lanes": lanes}
        asked.write.format("judgment_log").options(**options).mode("append").save()
        own = folded(f"{root}/run={run}", "judge-own").withColumnRenamed("found", "own")
        state = demand.join(before.drop("tries"), list(keys), "left").join(own, list(keys), "left").withColumn("found", F.coalesce("own", "found")).drop("own")
    sound = F.col("found").isNotNull()
    checkpoint = F.when(~sound, "failed-fallback").when(F.col("found.run") == run, "completed").otherwise("reused")
    return state.withColumns({
        "status": F.when(sound, "complete").otherwise("failed"),
        "raw_response": F.when(sound, F.col("found.answer")).otherwise(F.to_json(F.coalesce("tries", none))),
        "judge_checkpoint": checkpoint,
    }).drop("found", "tries")


def judgments_of(log: DataFrame, run: str, keys: tuple[str, ...] = KEYS, projects: list[str] | None = None) -> DataFrame:
    """The log as judgments (keys, status, raw_response), failed ones of this run alone."""
    known = fold_log(log, run, keys, projects).filter("found IS NOT NULL OR size(tries) > 0")
    return known.select(*keys, F.when(F.col("found").isNotNull(), "complete").otherwise("failed").alias("status"), F.coalesce("found.answer", F.to_json("tries")).alias("raw_response"))
