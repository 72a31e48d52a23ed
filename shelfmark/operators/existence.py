"""Which targets exist: only the folders that are targets are looked at.

``near_targets`` reduces a table of paths to those in target folders before anything is joined.  A ``PathTable`` is
stored for it: rows sorted by folder and name in files of delta-encoded (front-coded) strings, so that a probe for few folders reads
only the row groups whose range of folders has one.  ``on_disk`` lists the target folders themselves, in tasks, none below them.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import dirname
from shelfmark.tables import staged

#: Up to this many target folders are given to the scan as a filter, up to this many are broadcast; more are shuffled.
FILTERED, BROADCAST = 1000, 100_000
#: Most rows of a row group of a path table.
GROUP_BYTES = 1 << 20


def folders_of(operations: DataFrame) -> DataFrame:
    """The distinct target folders: folder."""
    return operations.select(dirname(F.col("new_path")).alias("folder")).distinct()


def near_targets(present: DataFrame, operations: DataFrame, folder: Column | None = None) -> DataFrame:
    """The rows of ``present`` (path, ...) in a folder that is a target's; ``folder``: theirs, if a column has it."""
    folders, own = folders_of(operations), dirname(F.col("path")) if folder is None else folder
    some = [r["folder"] for r in folders.limit(FILTERED + 1).collect()]
    if len(some) <= FILTERED:
        return present.where(own.isin(some) if some else F.lit(False))
    few = folders.limit(BROADCAST + 1).count() <= BROADCAST
    wanted = folders.select(F.col("folder").alias("__folder"))
    return present.join(F.broadcast(wanted) if few else wanted, own == F.col("__folder"), "left_semi")


class PathTable:
    """Paths on shared storage, sorted by folder and name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, present: DataFrame) -> PathTable:
        """Store (path, ...)."""
        rows = present.withColumn("folder", dirname(F.col("path"))).orderBy("folder", "path")
        rows.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("parquet.block.size", GROUP_BYTES).parquet(self.path)
        return self

    def near(self, operations: DataFrame) -> DataFrame:
        """The stored rows in target folders."""
        return near_targets(self.spark.read.parquet(self.path), operations, F.col("folder")).drop("folder")


def on_disk(operations: DataFrame) -> DataFrame:
    """Staged (path, is_file) of what is in the target folders now, and of the folders' own places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                paths, files = [], []
                if os.path.exists(folder):
                    paths.append(folder)
                    files.append(not os.path.isdir(folder))
                if os.path.isdir(folder):
                    with os.scandir(folder) as found:
                        for entry in found:
                            paths.append(os.path.join(folder, entry.name))
                            files.append(not entry.is_dir())
                            if len(paths) == 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.bool_())], names=["path", "is_file"])
                                paths, files = [], []
                if paths:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.bool_())], names=["path", "is_file"])

    return staged(folders_of(operations).mapInArrow(run, "path string, is_file boolean").distinct(), "present")
