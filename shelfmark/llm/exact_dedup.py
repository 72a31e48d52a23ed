"""Exact deduplication as a stateful stream (native: DataFrame and streaming operators only).

Every row becomes a *sighting* - digest, byte length, identifier and content locator (file and
row) - and a streaming aggregation keyed by digest and length folds the sightings into
RocksDB state: disk-backed, without watermark, hence without expiry.  State keeps the
identifier and locator of the row that stays and the number of sightings.  The state is read
back with Spark's ``statestore`` source.  On a hit (a digest seen more than once) full bytes
are compared with those of the retained row; texts that differ under one digest are
regrouped by their bytes.

Defined cases: a null text counts as empty; a null identifier is smaller than any other, and
of rows that tie in the largest identifier the one with the largest locator stays, so exactly
one row of a group does; very long texts only pass through the digest and the byte comparison;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import (
    col, located, members_bitmap, scratch, spread_join, staged, text_or_empty, with_maybe, without,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk, without preallocated files (which many small stores would fill the disk with);
#: what an executor's stores hold in memory together is bounded, and those of an ended query are
#: closed soon (by default after up to a minute), before later operators need the memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keeper_and_size() -> list[Column]:
    return [F.max(F.struct("id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("size")]


def fold(sightings: DataFrame, bytes_per_batch: int) -> DataFrame:
    """Fold a staged table of sightings into keyed state; one row (key, keeper, size) per key."""
    spark = sightings.sparkSession
    if sightings.isEmpty():  # a stream without rows writes no state
        return sightings.groupBy("key").agg(*keeper_and_size())
    state, before = scratch(spark, "state"), {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        files = {f.rpartition("/")[0] for f in sightings.inputFiles()}
        stream = spark.readStream.schema(sightings.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(*files)
        query = (
            stream.groupBy("key").agg(*keeper_and_size()).writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        found = spark.read.format("statestore").load(state)
        return staged(found.select("key.key", F.col("value.max").alias("keeper"), F.col("value.count").alias("size")), "groups")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def differing(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Keys under which not all texts have the same bytes.

    Only rows whose key was seen more than once move: others are dropped before the shuffle
    by a bitmap of fixed size.  All bytes of a key's hits are equal iff the least and the
    greatest are, which aggregates before the shuffle, so a hot key is no matter.
    """
    hits = with_maybe(rows, members_bitmap(groups.where("size > 1"), "key"), "key").where("__maybe")
    return hits.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("key")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: int = 16 << 30,
) -> DataFrame:
    """One row per row of ``docs``: id, file, row, keep_id, group_size, kept, digest."""
    return deduplicated(located(docs, id=col(id_col), text=text_or_empty(text_col)), digest, bytes_per_batch)


def deduplicated(placed: DataFrame, digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 16 << 30) -> DataFrame:
    """``exact_dedup`` of located rows (id, text, file, row)."""
    key = F.struct(digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = placed.select("id", "file", "row", key.alias("key"), "text")
    sightings = staged(rows.drop("text"), "sightings")
    groups = fold(sightings, bytes_per_batch)
    out = spread_join(sightings, groups, "key", "size")
    wrong = staged(differing(rows, groups), "differing")
    if not wrong.isEmpty():  # one digest, several texts: these keys are regrouped by their bytes
        bad = rows.join(wrong, "key", "left_semi")
        parts = staged(bad.groupBy("key", "text").agg(*keeper_and_size()), "regrouped")
        again = bad.join(parts, ["key", "text"]).select(*out.columns)
        out = spread_join(sightings.join(wrong, "key", "left_anti"), groups, "key", "size").unionByName(again)
    kept = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
    return out.select(
        "id", "file", "row", F.col("keeper.id").alias("keep_id"), F.col("size").alias("group_size"),
        kept.alias("kept"), F.col("key.digest").alias("digest"),
    )


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    base = located(docs, id=col(id_col), text=text_or_empty(text_col))
    gone = deduplicated(base).where("not kept").select("file", "row")
    return without(base, staged(gone, "dropped"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {"op6_exact_dedup": ORACLE}
