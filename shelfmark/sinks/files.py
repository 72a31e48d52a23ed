"""Files: texts that the driver writes, and many files that tasks write."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.operators import manifest as m
from shelfmark.sinks.documents import save


def write_text(path: str, text: str, append: bool = False) -> None:
    """Write or append, with the folders that are missing."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a" if append else "w", encoding="utf-8") as f:
        f.write(text)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def save_manifest(document: m.Manifest, path: str) -> None:
    save(m.json_document(document), path)


def save_markdown(document: m.Manifest, path: str, title: str = m.TITLE) -> None:
    save(m.markdown(document, title), path)


def in_tasks(files: DataFrame, work: Callable[..., None]) -> int:
    """Call ``work`` with the columns of each row, in the tasks that have the rows; the number of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                work(*row)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0


def make_files(files: DataFrame, root: str) -> int:
    """Write files of (rel_path, size) below a mounted folder; their number."""

    def make(path: str, size: int) -> None:
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.truncate(size)

    return in_tasks(files.select("rel_path", "size"), make)


def remove_files(files: DataFrame, root: str) -> int:
    """Remove files (rel_path) below a mounted folder that are there; the number of rows."""

    def remove(path: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(os.path.join(root, path))

    return in_tasks(files.select("rel_path"), remove)
