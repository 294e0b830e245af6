"""What several operators share: word patterns, table access, row keys, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import drop_stored, shared_dir, spread, store, with_positions

__all__ = ["WORD", "drop_stored", "fresh", "lookup", "map_texts", "release_shuffles", "row_key", "shared_dir", "slices", "small", "spread", "store", "table", "text_key", "texts", "with_positions", "words"]

#: Narrow rows (an id or a key and a few numbers) of a table that may be broadcast.
MOST_BROADCAST = 1_000_000
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are much work each."""
    return spread(table(spark, sf_dir, name))


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's context cleaner see that finished plans are unreachable.

    It removes the shuffle files of earlier phases only when the driver collects
    garbage, which a quiet driver does rarely.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """16 bytes that identify a row by its id and whole text, null ids included; equal rows share theirs."""
    return F.unhex(F.md5(F.concat(F.coalesce(_col(doc_id).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(_col(text), F.lit(""))).cast("binary")))


def text_key(text: str | Column = "text") -> Column:
    """16 bytes that identify a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(_col(text), F.lit("")).cast("binary")))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of narrow rows for a join: broadcast if its count (taken if not given) is MOST_BROADCAST at most, else shuffled."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= MOST_BROADCAST else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Spark bounds Arrow batches by bytes; workers take them in smaller portions of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(df: DataFrame, keep: list[str], inputs: list[str], run: Callable[..., dict[str, Any]], added: dict[str, str]) -> DataFrame:
    """keep and the columns that `run` makes of the input columns' lists, one value for each row.

    Kept columns stay in Arrow, so a null beside a large id does not turn it
    into a float. added: the new columns' Spark types.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = run(*[batch.column(c).to_pylist() for c in inputs])
            arrays = [batch.column(c) for c in keep] + [pa.array(got[c], kinds[t]) for c, t in added.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *added])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in keep), *(f"{c} {t}" for c, t in added.items())])
    return df.mapInArrow(each, schema)


def words(text: str | Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(WORD), F.lit(0))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, values: dict) -> Column:
    """A few constants by key, as a CASE expression."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key.eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
    return out
