"""Counts that follow a changing tree: signed rows are added up, and the first path of each label is kept.

Labels are a file's category and its operation's type; a row that is taken back (sign -1) counts off what it once added.  State is
kept by (kind, label, salt), the salt being a hash of the path, so a label with very many files is spread over ``SALTS`` keys; the
counts of the salts are merged when they are read.  The paths of a key are kept on disk, and its ``TOP`` smallest ones in a
buffer: the first path is the buffer's smallest.  The buffer is filled anew, by one pass over the paths, only when paths were taken away until it was
empty.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.config import Config
from shelfmark.functions.paths import clean, join
from shelfmark.operators.classify import classify, with_names
from shelfmark.operators.planning import TYPES, plan_operations
from shelfmark.operators.summary import category_label
from shelfmark.streaming.conflicts import ROCKSDB
from shelfmark.tables import mounted

SALTS, TOP = 16, 1000
OUT = "kind string, label string, salt int, n bigint, first string, seq bigint"


class LabelState(StatefulProcessor):
    """The paths of one (kind, label, salt): their number and the first."""

    def __init__(self, top: int):
        self.size = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paths = handle.getMapState("paths", "path string", "times bigint")
        self.top = handle.getValueState("top", "n bigint, whole boolean, smallest array<string>, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n, whole, smallest, seq = tuple(self.top.get()) if self.top.exists() else (0, True, [], 0)
        smallest = list(smallest)
        for r in rows:
            had = self.paths.getValue((r.path,))[0] if self.paths.containsKey((r.path,)) else 0
            has, n = had + r.sign, n + r.sign
            if has:
                self.paths.updateValue((r.path,), (has,))
            elif had:
                self.paths.removeKey((r.path,))
            if has > 0 >= had and (whole or (smallest and r.path < smallest[-1])):
                bisect.insort(smallest, r.path)
                if len(smallest) > self.size:
                    smallest.pop()
                    whole = False
            elif had > 0 >= has:
                i = bisect.bisect_left(smallest, r.path)
                if i < len(smallest) and smallest[i] == r.path:
                    smallest.pop(i)
        if not smallest and not whole:
            kept = (path for (path,), (times,) in self.paths.iterator() if times > 0)
            smallest = heapq.nsmallest(self.size + 1, kept)
            whole = len(smallest) <= self.size
            smallest = smallest[: self.size]
        self.top.update((n, whole, smallest, seq + 1))
        yield Row(kind=key[0], label=key[1], salt=key[2], n=n, first=smallest[0] if smallest else None, seq=seq + 1)

    def close(self) -> None:
        """Nothing to close."""


def labelled(signed: DataFrame, config: Config, base: str) -> DataFrame:
    """(kind, label, path, sign) of signed files (rel_path, sign): a row for the category, one for the operation."""
    files = classify(with_names(signed), config.categories).withColumn("original_path", join(clean(base), F.col("rel_path")))
    categories = files.select(F.lit("category").alias("kind"), category_label(F.col("category")).alias("label"), F.col("rel_path").alias("path"), "sign")
    planned = plan_operations(files.withColumn("scan_index", F.struct("rel_path", "sign")), config, base)
    return categories.unionByName(planned.select(F.lit("operation").alias("kind"), F.col("type").alias("label"), F.col("scan_index.rel_path").alias("path"), "scan_index.sign"))


class Counts:
    """Counts in a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, "file://" + mounted(folder)

    def start(self, rows: DataFrame, **trigger):
        """The running query over a stream of (kind, label, path, sign)."""
        own = rows.select("kind", "label", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"), "path", "sign")
        counted = own.groupBy("kind", "label", "salt").transformWithState(LabelState(TOP), OUT, "Update", "None")

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/log/{number:09d}")

        return counted.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(save).trigger(**trigger).start()

    def drain(self, rows: DataFrame) -> None:
        """Take in the rows that are there."""
        conf, before = self.spark.conf, self.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        try:
            self.start(rows, availableNow=True).awaitTermination()
        finally:
            conf.set("spark.sql.streaming.stateStore.providerClass", before)

    def current(self) -> DataFrame:
        """(kind, label, n, first): labels that files have now; all operation types, with 0 for those without."""
        rows = self.spark.read.schema(OUT).parquet(f"{self.folder}/log/*")
        last = rows.groupBy("kind", "label", "salt").agg(F.max_by(F.struct("n", "first"), "seq").alias("v"))
        none = self.spark.createDataFrame([("operation", t, 0, None) for t in TYPES], "kind string, label string, n bigint, first string")
        merged = last.select("kind", "label", "v.*").unionByName(none).groupBy("kind", "label").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        return merged.where("n > 0 OR kind = 'operation'")
