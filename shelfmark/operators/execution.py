"""Executing a plan: renames in tasks, with the outcomes of executing it in order.

Conflicts are resolved beforehand (``conflicts``), so what succeeds in order is known, and only operations that
depend on each other need an order: of a chain, in which each target is the source of the one before.  A chain is done by one task in order;
all others are dealt to all tasks.  Operations that lose are not tried.  Should a rename fail that was to succeed (no
permission, a missing source), those behind it get their turn: the next operation with its target, and, once that has
moved, what waited for its place; each wave is one job.  Outcomes are staged wave by wave.

A task that is repeated finds some of its renames done: the source is gone, the target is there.  Files have to be in folders that the
executors have mounted.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.conflicts import CONFLICT, dry_run, resolve_conflicts
from shelfmark.operators.existence import on_disk
from shelfmark.tables import staged

OUTCOME = "scan_index bigint, original_path string, new_path string, status string, error string"
Rename = Callable[[str, str], None]


def perform(source: str, target: str, rename: Rename = os.rename, again: bool = False) -> None:
    """Make the target's folder; refuse an existing target; rename.  ``again``: it may have been done."""
    if target != source and os.path.lexists(target):
        if again and not os.path.lexists(source):
            return
        raise FileExistsError(CONFLICT + target)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    rename(source, target)


def chains(winners: DataFrame) -> DataFrame:
    """Winners with ``chain``, the first operation of those that make room for each other; log rounds."""
    own = winners.select("scan_index", "original_path", "new_path")
    before = own.select(F.col("original_path").alias("new_path"), F.col("scan_index").alias("dep"))
    linked = staged(own.join(before, "new_path", "left").withColumn("chain", F.when(F.col("dep") < F.col("scan_index"), F.col("dep"))).drop("dep"), "links")
    while not linked.where("chain IS NOT NULL").join(linked.where("chain IS NOT NULL").select(F.col("scan_index").alias("chain")), "chain", "left_semi").isEmpty():
        up = linked.select(F.col("scan_index").alias("chain"), F.col("chain").alias("__up"))
        moved = linked.where("chain IS NOT NULL").join(up, "chain", "left").select("new_path", "scan_index", "original_path", F.coalesce("__up", "chain").alias("chain"))
        linked = staged(moved.unionByName(linked.where("chain IS NULL")), "links")
    return linked.withColumn("chain", F.coalesce("chain", "scan_index"))


def performed(operations: DataFrame, rename: Rename) -> DataFrame:
    """Rename what (chain, scan_index, original_path, new_path) says; staged OUTCOME rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = TaskContext.get().attemptNumber() > 0
        for batch in batches:
            status, errors = [], []
            for source, target in zip(*[batch.column(i).to_pylist() for i in (1, 2)], strict=True):
                try:
                    perform(source, target, rename, again)
                    status.append("success")
                    errors.append(None)
                except Exception as error:
                    status.append("failed")
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "status", "error"])

    dealt = operations.repartition("chain").sortWithinPartitions("chain", "scan_index").select("scan_index", "original_path", "new_path")
    return staged(dealt.mapInArrow(run, OUTCOME), "outcomes")


def turns(losers: DataFrame, wave: DataFrame) -> DataFrame:
    """The losers that get their turn after a wave: the first behind each that failed by itself or, having lost before, moved away."""
    failed = wave.where((F.col("status") == "failed") & ~F.startswith("error", F.lit(CONFLICT))).select("new_path", F.col("scan_index").alias("after"))
    moved = wave.where("status = 'success' AND late").select(F.col("original_path").alias("new_path"), F.col("scan_index").alias("after"))
    behind = losers.join(failed.unionByName(moved), "new_path").where("scan_index > after")
    first = behind.groupBy("new_path").agg(F.min_by(F.struct("scan_index", "original_path"), "scan_index").alias("o"))
    return first.select(F.col("o.scan_index").alias("chain"), "o.scan_index", "o.original_path", "new_path")


def execute(operations: DataFrame, dry: bool = False, rename: Rename = os.rename, logger=None, present: DataFrame | None = None) -> DataFrame:
    """operations + (status, error).

    present: all paths (``path``, ``is_file``) of the target folders at the start; they are listed if it isn't given.
    """
    if dry:
        if logger:
            logger.info("Dry run: no files are modified")
        return dry_run(operations)
    plan = staged(operations, "plan")
    expected = staged(resolve_conflicts(plan, on_disk(plan) if present is None else present, is_staged=True), "expected")
    losers = expected.where("status = 'failed'")
    wave = performed(chains(expected.where("status = 'success'")), rename).withColumn("late", F.lit(False))
    done = wave
    while not wave.where((F.col("late") & (F.col("status") == "success")) | ((F.col("status") == "failed") & ~F.startswith("error", F.lit(CONFLICT)))).isEmpty():
        rest = losers.join(done.select("scan_index"), "scan_index", "left_anti")
        wave = performed(turns(rest, wave), rename).withColumn("late", F.lit(True))
        done = done.unionByName(wave)
    outcome = done.select("scan_index", F.struct("status", "error").alias("__own"))
    met = expected.join(outcome, "scan_index", "left")
    tried = F.col("__own").isNotNull()
    results = met.withColumns({"status": F.when(tried, F.col("__own.status")).otherwise(F.col("status")), "error": F.when(tried, F.col("__own.error")).otherwise(F.col("error"))}).drop("__own")
    results = staged(results, "results")
    if logger:
        for op in results.orderBy("scan_index").toLocalIterator():
            if op["status"] == "success":
                logger.info(f"✓ {op['type']}: {op['original_path']} → {op['new_path']}")
            else:
                logger.error(f"✗ Failed: {op['original_path']}", {"error": op["error"]})
    return results
