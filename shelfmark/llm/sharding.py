"""Sharding by extendible hashing (native DataFrame operators).

Each row has a hash; a directory maps hash prefixes to shards.  A bucket whose bytes exceed the
limit splits on the next bit of the hash; all others keep their prefix.  Splitting needs byte
sums only, so rows are first summed into cells (prefixes a few bits longer than an average
shard needs); all prefixes of all cells are summed at once, and the shortest prefix within the
limit is the shard.  Cells that are still too large are split again on their next bits, row by
row, until none is.

The hash has 128 bits: 64 of the key columns (MD5 of their JSON), then 64 of the row's own address, so that rows
with one key (a hot source, say) split as well.  One row above the limit is a shard of its own,
flagged ``over_limit``.

Defined cases: a null text has 0 bytes; null keys hash like a value; repeated rows are told
apart by their address; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import col, located, staged, text_or_empty

#: Bits by which cells are finer than shards of average size.
FINER = 5
#: Bits of hash in all.
BITS = 128


def bits_of(key: Column) -> Column:
    """128 characters of 0 and 1: 64 for the key (a string), 64 for the row's address."""
    key = F.lpad(F.conv(F.substring(F.md5(key), 1, 16), 16, 2), 64, "0")
    row = F.lpad(F.bin(F.xxhash64(F.lit("row"), F.col("file"), F.col("row"))), 64, "0")
    return F.concat(key, row)


def split_level(rows: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """Shards among the prefixes of start..depth bits of rows (bits, n_bytes).

    One row per cell (prefix of ``depth`` bits): its shard - the shortest prefix whose bytes are
    within the limit, else the cell itself.
    """
    cells = rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(
        F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(start), F.lit(depth))))
    sums = levels.groupBy("d", F.expr("substring(cell, 1, d)").alias("prefix")).agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")
    )
    fits = staged(sums.where((F.col("shard_bytes") <= limit) | (F.col("d") == depth) | (F.col("shard_rows") == 1)), "fits")
    # prefixes shorter than the first that fits hold many rows and no shard
    shortest = fits.agg(F.min("d")).first()[0]
    levels = levels.where(F.col("d") >= (depth if shortest is None else shortest))
    named = levels.select("cell", "d", F.expr("substring(cell, 1, d)").alias("prefix")).join(fits, ["d", "prefix"])
    # the first bucket of each cell that needs no further split
    return named.groupBy("cell").agg(F.min(F.struct("d", "prefix", "shard_bytes", "shard_rows")).alias("s")).select("cell", "s.*")


def shard(docs: DataFrame, limit: int, keys: tuple = ("doc_id",), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, shard (hash prefix), depth, shard_bytes,
    shard_rows, over_limit."""
    rows = staged(
        located(docs, doc_id=col(id_col), n_bytes=F.octet_length(text_or_empty(text_col)).cast("long"), key=F.struct(*[col(k) for k in keys])).select(
            "doc_id", "n_bytes", bits_of(F.to_json("key")).alias("bits")
        ),
        "hashed",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, open_rows, start = [], rows, 0
    depth = min(BITS, FINER + max(0, (total // max(limit, 1)).bit_length()))
    while True:
        cells = staged(split_level(open_rows, start, depth, limit), "cells")
        met = open_rows.withColumn("cell", F.substring("bits", 1, depth)).join(cells, "cell")
        too_large = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
        if depth == BITS or cells.where(too_large).isEmpty():
            done.append(met)
            break
        done.append(met.where(~too_large))
        open_rows = staged(met.where(too_large).select("doc_id", "n_bytes", "bits"), "oversized")
        start, depth = depth, min(BITS, depth + FINER)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id", "n_bytes", F.col("prefix").alias("shard"), F.col("d").alias("depth"), "shard_bytes", "shard_rows",
        (F.col("shard_bytes") > limit).alias("over_limit"),
    )


def directory(sharded: DataFrame) -> DataFrame:
    """The directory: one row per shard with its prefix, local depth, bytes and rows."""
    return sharded.groupBy("shard").agg(
        F.max("depth").alias("depth"), F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows")
    )


#: Byte limit of a shard in the registered query.
SHARD_BYTES = 1 << 20


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARD_BYTES)


QUERIES = {"op7_sharding": op7_sharding}

#: The same hash, split bit by bit.
ORACLE = f"""WITH RECURSIVE d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    lpad(bin(CAST('0x' || left(md5('{{' || coalesce('"doc_id":' || doc_id, '') || '}}'), 16) AS UBIGINT)), 64, '0') AS bits FROM documents),
buckets AS (
  SELECT '' AS shard, CAST(0 AS INT) AS depth, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM d
  UNION ALL
  SELECT left(bits, depth + 1), depth + 1, CAST(sum(n_bytes) AS BIGINT), count(*)
  FROM buckets JOIN d ON left(bits, depth) = shard WHERE shard_bytes > {SHARD_BYTES} AND shard_rows > 1 AND depth < 64 GROUP BY ALL)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} AS over_limit
FROM buckets JOIN d ON left(bits, depth) = shard WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1"""

ORACLES = {"op7_sharding": ORACLE}
