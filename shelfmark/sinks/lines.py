"""Text lines written once: a data source whose tasks write files that a commit makes count.

``df.write.format("shelfmark_lines")`` (or ``writeStream``) takes one string column.  A task attempt writes one file of its own
name; the commit lists the files of the attempts that succeeded, in the order of their partitions, in one new
file of the folder ``_commits``.  Readers take what is listed there, so a lost, repeated or speculative attempt adds nothing, and a
streaming batch that is replayed after its commit is dropped.  Nothing is moved or renamed, which suits
object stores.  A header is written with the first commit that has lines.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

NAME = "shelfmark_lines"
COMMITS = "_commits"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    lines: int


class Lines:
    """What batch and streaming writers share."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.header, self.suffix = options.get("header"), options.get("suffix", "txt")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        partition, n = TaskContext.get().partitionId(), 0
        files, root = opened(self.path)
        name = f"part-{partition:05d}-{uuid.uuid4().hex}.{self.suffix}"
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                if batch.num_rows:
                    out.write(("\n".join(x or "" for x in batch.column(0).to_pylist()) + "\n").encode())
                    n += batch.num_rows
        return Written(partition, name, n)

    def commit_as(self, messages: list[Written | None], number: int) -> None:
        files, root = opened(self.path)
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        log, before = f"{root}/{COMMITS}", numbers(files, root)
        if number in before:  # a replayed batch
            self.drop(done)
            return
        names = [m.name for m in done if m.lines]
        if names and self.header is not None and (self.overwrite or not any(noted(files, root, n)[0] for n in before)):
            head = f"head-{uuid.uuid4().hex}.{self.suffix}"
            with files.open_output_stream(f"{root}/{head}") as out:
                out.write(f"{self.header}\n".encode())
            names.insert(0, head)
        files.create_dir(log, recursive=True)
        with files.open_output_stream(f"{log}/.{number}.tmp") as out:
            out.write(json.dumps({"files": names, "fresh": self.overwrite}).encode())
        files.move(f"{log}/.{number}.tmp", f"{log}/{number:012d}.json")
        self.drop([m for m in done if not m.lines])
        if self.overwrite:  # what the new commit replaces
            for old in before:
                replaced, _ = noted(files, root, old)
                files.delete_file(f"{log}/{old:012d}.json")
                self.drop([Written(0, name, 0) for name in replaced])

    def drop(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        for m in messages:
            if m and files.get_file_info(f"{root}/{m.name}").type != fs.FileType.NotFound:
                files.delete_file(f"{root}/{m.name}")


class BatchWriter(Lines, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.commit_as(messages, max(numbers(*opened(self.path)), default=-1) + 1)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(messages)


class StreamWriter(Lines, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.commit_as(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(dict(self.options))


def numbers(files: fs.FileSystem, root: str) -> list[int]:
    """The commits, in order."""
    found = files.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def noted(files: fs.FileSystem, root: str, number: int) -> tuple[list[str], bool]:
    """The files of a commit, and whether it replaces those before."""
    with files.open_input_stream(f"{root}/{COMMITS}/{number:012d}.json") as f:
        data = json.loads(f.read())
    return data["files"], data["fresh"]


def committed(path: str) -> list[str]:
    """The files that count, in order; their concatenation is the whole text."""
    files, root = opened(path)
    out: list[str] = []
    for n in numbers(files, root):
        names, fresh = noted(files, root, n)
        out = [] if fresh else out
        out += [f"{path.rstrip('/')}/{name}" for name in names]
    return out


def write_lines(lines: DataFrame, path: str, header: str | None = None, suffix: str = "txt", mode: str = "append") -> None:
    """Write one string column, in the order of its rows; modes are append and overwrite."""
    lines.sparkSession.dataSource.register(LinesSource)
    writer = lines.write.format(NAME).mode(mode).option("suffix", suffix)
    (writer if header is None else writer.option("header", header)).save(path)


def stream_lines(lines: DataFrame, path: str, checkpoint: str, header: str | None = None, suffix: str = "txt"):
    """A stream writer of one string column; each batch is committed once."""
    lines.sparkSession.dataSource.register(LinesSource)
    writer = lines.writeStream.format(NAME).option("path", path).option("checkpointLocation", checkpoint).option("suffix", suffix)
    return writer if header is None else writer.option("header", header)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The committed lines: (file, line); ``file`` orders nothing, ``committed`` does."""
    files = committed(path)
    if not files:
        return spark.createDataFrame([], "file string, line string")
    return spark.read.option("lineSep", "\n").text(files).selectExpr("_metadata.file_name AS file", "value AS line")
