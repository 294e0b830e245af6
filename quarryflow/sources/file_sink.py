"""A sink that writes each row as a file of its own, below a folder that appears as a whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.scratch import qualified
from .page_log import file_system


@dataclass
class _Written(WriterCommitMessage):
    count: int


class _Writer(DataSourceWriter):
    """Tasks write below a hidden folder; a task that is repeated writes the same files again. The commit renames the folder."""

    def __init__(self, target: str):
        head, _, name = target.rstrip("/").rpartition("/")
        self.target, self.hidden = target.rstrip("/"), f"{head}/_{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = file_system(self.hidden)
        count, made = 0, set()
        for row in iterator:
            folder = f"{root}/{row['path']}".rpartition("/")[0]
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            with files.open_output_stream(f"{root}/{row['path']}") as f:
                f.write((row["body"] or "").encode())
            count += 1
        return _Written(count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, hidden = file_system(self.hidden)
        _, target = file_system(self.target)
        files.create_dir(hidden, recursive=True)  # no rows, no files
        files.move(hidden, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        files, hidden = file_system(self.hidden)
        if files.get_file_info(hidden).type != FileType.NotFound:
            files.delete_dir(hidden)


class FileSink(DataSource):
    """Options: path, an address with its scheme. Columns: path (below it, unique), body."""

    @classmethod
    def name(cls) -> str:
        return "file_sink"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Writes rows of path and body as files below a folder that is not there yet."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    target = qualified(spark, path)
    from pyarrow.fs import FileType

    files, place = file_system(target)
    if files.get_file_info(place).type != FileType.NotFound:
        raise FileExistsError(f"{path} exists")
    rows.select("path", "body").write.format("file_sink").option("path", target).mode("append").save()
