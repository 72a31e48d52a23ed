"""Set-based outcome of executing operations in order.

Operations run by ``scan_index``; one fails if its target exists at that moment.  With ``k(p)``
the operation whose source is ``p``, operation i with target p succeeds iff it is the first one
to target p among those after k(p) (among all, if there is no k(p)), and p was not present at
the start, or k(p) comes before i and itself succeeds.  Each operation depends on at most one
earlier one, so chains are followed by pointer doubling: the number of rounds is the logarithm of
the longest chain, and none is needed if there are no chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import dirname
from shelfmark.operators.existence import near_targets
from shelfmark.tables import staged

CONFLICT = "Target file already exists: "
BLOCKED = "Target directory is a file: "


def with_target_exists(operations: DataFrame, present: DataFrame) -> DataFrame:
    """The existence probe: operations + ``target_exists``, whether a present path is their target."""
    there = near_targets(present.select("path"), operations).select(F.col("path").alias("new_path")).distinct().withColumn("__there", F.lit(True))
    return operations.join(there, "new_path", "left").withColumn("target_exists", F.coalesce("__there", F.lit(False))).drop("__there")


def resolve_conflicts(operations: DataFrame, present: DataFrame, is_staged: bool = False) -> DataFrame:
    """operations + (status, error), as sequential execution would give them.

    present: all paths at the start (``path``, optionally ``is_file``), hidden and excluded ones
    and directories too.  Without ``is_file``, no path counts as a file in a directory's place.
    Paths that are no targets only cost their reading; ``existence`` leaves them out.
    Operations are read several times, so they are staged unless they are already.
    """
    ops = operations = operations if is_staged else staged(operations, "operations")
    if "is_file" in present.columns:
        files = present.where("is_file").select(F.col("path").alias("__dir")).distinct()
        ops = ops.withColumn("__dir", dirname(F.col("new_path"))).join(files.withColumn("__blocked", F.lit(True)), "__dir", "left").drop("__dir")
    else:
        ops = ops.withColumn("__blocked", F.lit(None).cast("boolean"))
    able = ops.where("__blocked IS NULL AND new_path <> original_path").select("scan_index", "original_path", "new_path")
    sources = able.select(F.col("original_path").alias("new_path"), F.col("scan_index").alias("k"))
    # a source that stays where it is never leaves; it counts as present, not as leaving
    after = able.join(sources, "new_path", "left").where("k IS NULL OR scan_index > k")
    first = after.groupBy("new_path").agg(F.min(F.struct("scan_index", "k")).alias("f")).select("new_path", "f.scan_index", "f.k")
    there = present.select(F.col("path").alias("new_path")).distinct().withColumn("__there", F.lit(True))
    cand = staged(
        first.join(there, "new_path", "left").select(
            "scan_index", F.col("k").alias("dep"), (F.col("k").isNotNull() | F.col("__there").isNull()).alias("ok")
        ),
        "candidates",
    )
    while not cand.where("dep IS NOT NULL").isEmpty():
        up = cand.select(F.col("scan_index").alias("dep"), F.col("dep").alias("__dep"), F.col("ok").alias("__ok"))
        # an operation that is no candidate fails, and so does what waits for its source to leave
        cand = staged(
            cand.where("dep IS NOT NULL").join(up, "dep", "left")
            .select("scan_index", F.col("__dep").alias("dep"), F.coalesce("__ok", F.lit(False)).alias("ok"))
            .unionByName(cand.where("dep IS NULL")),
            "candidates",
        )
    won = cand.where("ok").select("scan_index").withColumn("__won", F.lit(True))
    status = F.when(F.col("__blocked"), "failed").when((F.col("new_path") == F.col("original_path")) | F.col("__won"), "success").otherwise("failed")
    error = F.when(F.col("__blocked"), F.concat(F.lit(BLOCKED), dirname(F.col("new_path")))).when(
        F.col("status") == "failed", F.concat(F.lit(CONFLICT), F.col("new_path"))
    )
    return ops.join(won, "scan_index", "left").withColumn("status", status).withColumn("error", error).drop("__blocked", "__won")


def dry_run(operations: DataFrame) -> DataFrame:
    """All operations count as successful; nothing is predicted."""
    return operations.withColumns({"status": F.lit("success"), "error": F.lit(None).cast("string")})
