"""One document of many rows, written by many tasks into one file.

A document is a head, blocks in an order, and a tail.  The blocks are sorted by range; a task numbers its blocks
and sums up their bytes as it writes them, and the sums of the tasks before give each block its number and
its byte offset.  ``save`` makes a file of the final size, into which tasks write their blocks in place; a
repeated task writes the same bytes to the same place, and the file gets its name once all are there.  No row and no task holds more than a
block at a time, and the driver holds one number per task.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.tables import mounted, staged

#: A task gathers consecutive blocks up to about this many bytes for one write.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Document:
    """``blocks`` has a column ``block``; it is sorted by ``order``, which must be total."""

    blocks: DataFrame
    order: tuple[str | Column, ...]
    head: str = ""
    between: str = ""
    tail: str = ""


def numbered(document: Document) -> DataFrame:
    """Staged (task, place, before, block): numbers and bytes within the task that wrote them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            ends = pc.add(pc.cumulative_sum(pc.cast(pc.binary_length(batch.column(0)), pa.int64())), before)
            starts = pc.subtract(ends, pc.cast(pc.binary_length(batch.column(0)), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), starts, batch.column(0)], names=["task", "place", "before", "block"])
            if n:
                place, before = place + n, ends[-1].as_py()

    blocks = document.blocks.orderBy(*document.order).select(F.coalesce("block", F.lit("")).alias("block"))
    return staged(blocks.mapInArrow(run, "task bigint, place bigint, before bigint, block string"), "blocks")


def chunks(document: Document) -> tuple[DataFrame, int]:
    """((place, offset, chunk), bytes in all): the head at place 0, then the blocks, then the tail.

    A chunk is a block with what stands between it and the one before.
    """
    spark, own = document.blocks.sparkSession, numbered(document)
    sums = own.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("block")).alias("bytes")).orderBy("task").collect()  # a row per task
    head, between, tail = (len(x.encode()) for x in (document.head, document.between, document.tail))
    starts, n, size = [], 0, head
    for r in sums:
        starts.append((r["task"], n, size))
        n, size = n + r["n"], size + r["bytes"]
    table = spark.createDataFrame(starts, "task bigint, first bigint, start bigint")
    met = own.join(F.broadcast(table), "task")  # a row per task
    later = F.col("first") + F.col("place") > 0
    body = met.select(
        (F.col("first") + F.col("place") + 1).alias("place"),
        (F.col("start") + F.col("before") + between * F.greatest(F.col("first") + F.col("place") - 1, F.lit(0))).alias("offset"),
        F.concat(F.when(later, document.between).otherwise(""), F.col("block")).alias("chunk"),
    )
    size += between * max(0, n - 1)
    ends = [(0, 0, document.head)] * bool(head) + [(n + 1, size, document.tail)] * bool(tail)
    if ends:
        body = spark.createDataFrame(ends, "place bigint, offset bigint, chunk string").coalesce(1).unionByName(body)
    return body, size + tail


def written(rows: DataFrame, path: str) -> DataFrame:
    """Write (offset, chunk) into a file that is there; the bytes of each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at, pending = 0, 0, bytearray()
        with open(path, "r+b") as f:

            def flush() -> int:
                f.seek(at)
                f.write(pending)
                return len(pending)

            for batch in batches:
                for offset, chunk in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if offset != at + len(pending) or len(pending) >= TOGETHER:
                        total += flush()
                        at, pending = offset, bytearray()
                    pending += chunk.encode()
            total += flush()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["bytes"])

    return rows.select("offset", "chunk").mapInArrow(run, "bytes bigint")


def save(document: Document, path: str) -> int:
    """Write the document to a file in a mounted folder; its bytes."""
    path = os.path.abspath(mounted(path))
    rows, size = chunks(document)
    part = f"{path}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    try:
        with open(part, "wb") as f:
            f.truncate(size)
        done = written(rows, part).groupBy().sum("bytes").first()[0] or 0
        if done != size:
            raise OSError(f"{done} of {size} bytes were written to {path}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return size
