"""Scratch tables in the cluster's shared folder, and global row positions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
#: Rows of a range that `with_positions` sorts, on average at most.
RANGE_ROWS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Without `spark.checkpoint.dir` only a local master can go on, since there
    all tasks run on this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="quarryflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_dirs[app] = "file://" + folder
    return _local_dirs[app]


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/quarryflow/{spark.sparkContext.applicationId}"


def clean_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application, once its results are written."""
    delete(spark, scratch_dir(spark))


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, folder)
    return files.exists(path)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names of what a folder holds, hidden ones aside; none if it is not there."""
    path, files = _path(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return [n for n in names if n[0] not in "._"]


def read_file(spark: SparkSession, file: str) -> str:
    """A small file as text."""
    path, files = _path(spark, file)
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_file(spark: SparkSession, file: str, text: str) -> bool:
    """Writes a small file under a hidden name and renames it; False if the file is there already."""
    path, files = _path(spark, file)
    hidden, _ = _path(spark, f"{path.getParent().toString()}/_{uuid.uuid4().hex}")
    out = files.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    # a rename onto a file that exists fails on most stores; asking first covers those where it replaces it
    done = not files.exists(path) and files.rename(hidden, path)
    if not done:
        files.delete(hidden, False)
    return done


def write_file(spark: SparkSession, file: str, pieces: Iterable[bytes]) -> None:
    """A file of pieces on any store that Spark writes to; one that is there is replaced."""
    path, files = _path(spark, file)
    out = files.create(path, True)
    try:
        for piece in pieces:
            out.write(bytearray(piece))
    finally:
        out.close()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as an address that is the same on all machines, with its scheme."""
    path, files = _path(spark, folder)
    found = files.makeQualified(path).toString()
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    It cuts the lineage, so a lost executor costs the tasks it ran and no more,
    and later plans see a plain scan.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, which are few tasks however much work a row is, dealt evenly; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that `store` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def with_positions(df: DataFrame, order: Sequence[str], size: str | None = None, name: str = "ordered") -> DataFrame:
    """Adds `row_pos` (from 0) and, given `size`, `offset` (the sizes before) in a global order.

    Rows are dealt by ranges of the order, each partition's totals (a row for
    each partition) become prefix sums, and a running window inside each
    partition does the rest. No partition sees more than its range: a random
    number after the order parts even rows that are all alike, and large tables
    get a partition for every `RANGE_ROWS` rows.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    order = [*order, "__tie"]
    dealt = store(df.withColumn("__tie", F.rand(11)).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name)
    total = F.sum(size) if size else F.lit(0)
    base_rows = base_size = 0
    bases = []
    for part, n, s in sorted(dealt.groupBy("__part").agg(F.count("*"), total).collect()):
        bases.append((part, base_rows, base_size))
        base_rows, base_size = base_rows + n, base_size + (s or 0)
    before = spark.createDataFrame(bases, "__part int, __rows long, __size long")
    w = Window.partitionBy("__part").orderBy(*order)
    out = dealt.join(F.broadcast(before), "__part").withColumn("row_pos", F.col("__rows") + F.row_number().over(w) - 1)
    if size:
        upto = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn("offset", F.col("__size") + upto - F.col(size))
    return out.drop("__part", "__rows", "__size", "__tie")
