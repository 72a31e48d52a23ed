"""Incremental scans: what was added, changed or removed since the scan before.

``Watch.poll`` lists a directory (by the rounds of ``sources.inventory``), compares it with the snapshot of the poll before by
one full outer join on the path, and commits snapshot and differences under the next version: everything is written first, and one
small file makes it count.  A poll that dies leaves no trace that a later one would read.

``changes`` is a streaming DataFrame over the committed versions (format ``shelfmark_changes``): its offsets are versions,
so a restarted query goes on with the first version it hasn't finished, and repeats none.  Each change comes as signed rows
(``sign``): an added file +1, a removed one -1, a changed one -1 with what it was and +1 with what it is; sums over them are
sums over the present snapshot.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shelfmark.sources.inventory import SCHEMA as ENTRY_SCHEMA
from shelfmark.sources.inventory import listing
from shelfmark.tables import mounted

NAME = "shelfmark_changes"
SCHEMA = "version bigint, kind string, sign int, rel_path string, size bigint, is_file boolean, modified bigint"
FIELDS = ["version", "kind", "sign", "rel_path", "size", "is_file", "modified"]


def versions(state: str) -> list[int]:
    """The committed versions, in order."""
    folder = os.path.join(mounted(state), "commits")
    return sorted(int(n.removesuffix(".json")) for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []


def differences(before: DataFrame, now: DataFrame, version: int) -> DataFrame:
    """Signed rows between two snapshots (rel_path, size, is_file, modified)."""
    old = before.select(F.col("rel_path").alias("__path"), F.struct("rel_path", "size", "is_file", "modified").alias("old"))
    new = now.select("rel_path", F.struct("rel_path", "size", "is_file", "modified").alias("new"))
    both = old.join(new, F.col("__path") == F.col("rel_path"), "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").otherwise("changed")
    rows = F.array_compact(F.array(
        F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("e"))),
        F.when(F.col("new").isNotNull(), F.struct(F.lit(1).alias("sign"), F.col("new").alias("e"))),
    ))
    return both.select(F.lit(version).cast("bigint").alias("version"), kind.alias("kind"), F.explode(rows).alias("r")).select("version", "kind", "r.sign", "r.e.*")


class Watch:
    """Snapshots of a directory in a state folder; both are mounted by the driver and the executors."""

    def __init__(self, spark: SparkSession, directory: str, state: str, exclude: Sequence[str] = (), include_hidden: bool = False):
        self.spark, self.directory, self.state = spark, directory, mounted(state)
        self.exclude, self.include_hidden = tuple(exclude), include_hidden

    def path(self, kind: str, version: int) -> str:
        return f"{self.state}/{kind}/{version:012d}"

    def snapshot(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).parquet("file://" + self.path("snapshots", version))

    def poll(self) -> int:
        """Scan, compare, commit; the new version."""
        last = max(versions(self.state), default=0)
        version = last + 1
        found = listing(self.spark, self.directory, self.exclude, self.include_hidden, times=True)
        found.write.mode("overwrite").parquet("file://" + self.path("snapshots", version))
        changed = differences(self.snapshot(last), self.snapshot(version), version)
        changed.write.mode("overwrite").parquet("file://" + self.path("changes", version))
        os.makedirs(f"{self.state}/commits", exist_ok=True)
        files = sorted(n for n in os.listdir(self.path("changes", version)) if n.endswith(".parquet"))
        with open(f"{self.path('commits', version)}.tmp", "w", encoding="utf-8") as f:
            json.dump({"files": files}, f)
        os.replace(f"{self.path('commits', version)}.tmp", f"{self.path('commits', version)}.json")
        if last > 1:  # no poll compares with it any more
            shutil.rmtree(self.path("snapshots", last - 1), ignore_errors=True)
        return version


class ChangesPart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChangesReader(DataSourceStreamReader):
    def __init__(self, state: str):
        self.state = mounted(state)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max(versions(self.state), default=0)}

    def partitions(self, start: dict, end: dict) -> list[ChangesPart]:
        out = []
        for v in range(start["version"] + 1, end["version"] + 1):
            with open(f"{self.state}/commits/{v:012d}.json", encoding="utf-8") as f:
                out += [ChangesPart(f"{self.state}/changes/{v:012d}/{name}") for name in json.load(f)["files"]]
        return out

    def read(self, partition: ChangesPart) -> Iterator[pa.RecordBatch]:
        with pq.ParquetFile(partition.path) as file:
            yield from file.iter_batches(10_000, columns=FIELDS)

    def commit(self, end: dict) -> None:
        """Changes stay: other queries may read them."""


class ChangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangesReader:  # noqa: N802
        return ChangesReader(self.options["path"])


def changes(spark: SparkSession, state: str) -> DataFrame:
    """The stream of signed rows of a state folder: see SCHEMA."""
    spark.dataSource.register(ChangesSource)
    return spark.readStream.format(NAME).load(state)
