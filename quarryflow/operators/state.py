"""State tables as versions of Parquet: keyed upserts, runs, feedback."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import delete, exists, with_positions
from ..functions.text import text_or_empty

#: The states of reading.
READING = ("new", "saved", "reading", "read", "ignored", "cited")


def fold_batch(batch: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """A batch that repeats a key acts like upserts one after another: the last row's columns, the first row's time."""
    rest = [c for c in batch.columns if c not in keys]
    last = F.max_by(F.struct(*rest), ord).alias("__last")
    return batch.groupBy(*keys).agg(last, F.min("seen_at").alias("__first_at"), F.max("seen_at").alias("__last_at")).select(*keys, "__last.*", "__first_at", "__last_at")


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], replace: list[str], defaults: dict[str, Column], ord: str = "ord") -> DataFrame:
    """The state after a batch, with is_new.

    Known keys keep their first_seen and every column that is not in `replace`;
    new keys take the batch's columns, `defaults` for the rest, and the time of
    their first row. last_seen follows the batch.
    """
    new = fold_batch(batch, keys, ord)
    joined = state.withColumn("__known", F.lit(True)).alias("s").join(new.alias("b"), keys, "full_outer")
    known, came = F.coalesce(F.col("__known"), F.lit(False)), F.col("__last_at").isNotNull()
    out = []
    for c in state.columns:
        if c in keys:
            value = F.col(c)
        elif c == "first_seen":
            value = F.when(known, F.col("s.first_seen")).otherwise(F.col("__first_at"))
        elif c == "last_seen":
            value = F.when(came, F.col("__last_at")).otherwise(F.col("s.last_seen"))
        elif c in replace:
            value = F.when(came, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}"))
        else:
            value = F.when(known, F.col(f"s.{c}")).otherwise(defaults.get(c, F.lit(None)))
        out.append(value.alias(c))
    return joined.select(*out, (~known).alias("is_new"), came.alias("in_batch"))


def with_ids(after: DataFrame, keys: list[str], id: str = "id") -> DataFrame:
    """The state of an upsert with numbers for its new rows, after the greatest so far, in order of their keys."""
    top = after.agg(F.max(id)).first()[0] or 0
    fresh = with_positions(after.filter(F.col(id).isNull()), keys, name="state-ids")
    return after.filter(F.col(id).isNotNull()).unionByName(fresh.withColumn(id, F.col("row_pos") + top + 1).drop("row_pos"))


def update_analysis(state: DataFrame, analysed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The state with the analysed columns of the records that were analysed; rows of other keys keep theirs.

    analysed: keys and columns, one row for each key.
    """
    new = analysed.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__came"))
    joined = state.join(new, keys, "left")
    return joined.select(*[F.when(F.col("__came"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in state.columns])


POINTER = "version int, stream string, batch long"


def write_version(df: DataFrame, root: str, name: str, version: int, keep: int = 3, stream: tuple[str, int] = (None, None)) -> None:
    """A new version beside the old ones, then the pointer; a reader never sees half a table.

    The pointer notes which batch of which stream the version took in, if any.

    Data without a pointer are what a failed attempt left: they are written
    anew. Of versions that have one the last `keep` stay, for readers that are
    still at work.
    """
    spark = df.sparkSession
    written = versions(spark, root, name)
    if version in written:
        raise ValueError(f"version {version} of {name} exists")
    df.write.mode("overwrite").parquet(f"{root}/{name}/v={version}")
    pointer = spark.createDataFrame([(version, *stream)], POINTER).coalesce(1)
    pointer.write.mode("append").parquet(f"{root}/{name}_versions")
    for old in sorted(written)[: -keep + 1 or None] if keep > 1 else sorted(written):
        delete(spark, f"{root}/{name}/v={old}")


def versions(spark: SparkSession, root: str, name: str) -> set[int]:
    """The versions that have a pointer."""
    return {r[0] for r in pointers(spark, root, name).select("version").distinct().collect()}


def pointers(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}_versions"
    return spark.read.schema(POINTER).parquet(path) if exists(spark, path) else spark.createDataFrame([], POINTER)


def read_version(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, int]:
    """The newest version and its number."""
    known = versions(spark, root, name)
    if not known:
        raise FileNotFoundError(f"{root} has no table {name}")
    return spark.read.parquet(f"{root}/{name}/v={max(known)}"), max(known)


def read_or_empty(spark: SparkSession, root: str, name: str, schema: str, steps: tuple[Step, ...] = ()) -> tuple[DataFrame, int]:
    """The newest version as it would be written today, or an empty table as version 0."""
    if not versions(spark, root, name):
        return spark.createDataFrame([], schema), 0
    found, version = read_version(spark, root, name)
    return migrated(found, schema, steps), version


@dataclass(frozen=True)
class Step:
    """A change of a table's schema: `column` came with the value of `default`, an SQL expression over the columns before it."""

    number: int
    column: str
    default: str = "NULL"


def migrated(df: DataFrame, schema: str, steps: tuple[Step, ...] = ()) -> DataFrame:
    """A version of any age in the schema of today.

    Steps run in the order of their numbers and skip what the version has;
    further columns that it lacks are null, those that the schema does not know
    stay behind the others, and types follow the schema.
    """
    for step in sorted(steps, key=lambda s: s.number):
        if step.column not in df.columns:
            df = df.withColumn(step.column, F.expr(step.default))
    wanted = df.sparkSession.createDataFrame([], schema).dtypes
    known = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted]
    return df.select(*known, *[c for c in df.columns if c not in dict(wanted)])


RUNS = "run_id string, profile string, from_date string, to_date string, started_at string, finished_at string, counts map<string, long>, errors string"


def start_run(spark: SparkSession, path: str, profile: str, from_date: str, to_date: str, now: str) -> str:
    """Appends an open run to the ledger and returns its id; a crash leaves it without an end."""
    run_id = uuid.uuid4().hex
    spark.createDataFrame([(run_id, profile, from_date, to_date, now, None, None, None)], RUNS).coalesce(1).write.mode("append").parquet(path)
    return run_id


def finish_run(spark: SparkSession, path: str, run_id: str, counts: dict[str, int], errors: str, now: str) -> None:
    spark.createDataFrame([(run_id, None, None, None, None, now, counts, errors)], RUNS).coalesce(1).write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with one row for each run: the rows of its start and its end folded."""
    rows = spark.read.schema(RUNS).parquet(path)
    cols = [c for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def check_feedback(records: DataFrame) -> DataFrame:
    """Adds status, rating_value and reason (null if the record is sound), before papers are looked up."""
    rating = F.nullif(text_or_empty("rating"), F.lit(""))
    value = F.try_to_number(F.regexp_extract(rating, r"^\s*(-?\d+)(\.\d*)?\s*$", 1), F.lit("S999999999")).cast("int")
    status = F.coalesce(F.nullif(F.col("reading_status"), F.lit("")), F.nullif(F.col("action"), F.lit("")), F.lit("saved"))
    reason = F.when(rating.isNotNull() & (value.isNull() | ~value.between(1, 5)), "rating must be 1..5").when(~status.isin(*READING), F.concat(F.lit("invalid reading_status: "), status))
    return records.withColumns({"rating_value": value, "status": status, "reason": reason})


def resolve_feedback(records: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors): records find their paper by paper_id, else by stable_id. Each record is taken whole or not at all."""
    checked = check_feedback(records)
    by_id = papers.select(F.col("id").alias("__id")).distinct()
    by_stable = papers.groupBy(F.col("stable_id").alias("__stable")).agg(F.min("id").alias("__found"))
    found = checked.join(by_id, F.col("paper_id") == F.col("__id"), "left").join(by_stable, F.col("paper_id").isNull() & (F.col("stable_id") == F.col("__stable")), "left")
    found = found.withColumn("resolved_id", F.coalesce("__id", "__found")).withColumn("reason", F.coalesce("reason", F.when(F.col("resolved_id").isNull(), "paper not found")))
    # an id that no paper has is refused, so feedback never refers to nothing
    accepted = found.filter("reason IS NULL").drop("__id", "__stable", "__found", "reason")
    errors = found.filter("reason IS NOT NULL").select("ord", F.concat(F.lit("record "), F.col("ord"), F.lit(": "), F.col("reason")).alias("error"))
    return accepted, errors


FEEDBACK = "paper_id long, rating int, action string, note string, project string, timestamp string"


def feedback_rows(accepted: DataFrame, now: str) -> DataFrame:
    """The accepted records as rows of the feedback table."""
    have = lambda c: text_or_empty(c) if c in accepted.columns else F.lit("")
    project = F.when(have("related_project") != "", have("related_project")).otherwise(have("project"))
    at = F.when(have("timestamp") != "", have("timestamp")).otherwise(F.lit(now))
    return accepted.select(F.col("resolved_id").alias("paper_id"), F.col("rating_value").alias("rating"), F.col("status").alias("action"), have("note").alias("note"), project.alias("project"), at.alias("timestamp"))


def apply_feedback(papers: DataFrame, accepted: DataFrame) -> DataFrame:
    """The papers with the status of their latest accepted feedback."""
    last = accepted.groupBy(F.col("resolved_id").alias("id")).agg(F.max_by("status", "ord").alias("__status"))
    return papers.join(last, "id", "left").withColumn("reading_status", F.coalesce("__status", "reading_status")).drop("__status")
