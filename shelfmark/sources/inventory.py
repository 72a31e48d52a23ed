"""Directory listings by rounds of tasks, and their filters.

``binaryFile`` would drop empty files and those whose name starts with ``_`` or ``.``, so tasks list
the tree themselves.  Folders are rows: a round deals the folders known so far (the frontier) to tasks of equal
estimated work; a task lists its folders, goes on into what it finds until it has done its share, and gives
the folders that are left as the next frontier.  So neither a deep chain nor a broad tree makes a long task, and the driver
lists nothing.  Of a folder with many entries the first ``CUT`` are described where they are listed; the names of the others are
dealt to the tasks of the next round in packs.  The path has to be visible to the executors.

Excluded entries are not described, and folders below which nothing can survive are not entered: the state of an
automaton over path segments (``functions.pruning``) travels with each folder.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import Config
from shelfmark.functions.globs import glob_regex
from shelfmark.functions.paths import clean, join
from shelfmark.functions.pruning import Pruner, State
from shelfmark.operators.classify import classify, with_names
from shelfmark.operators.planning import with_suggestions
from shelfmark.tables import mounted, scratch, staged

#: Entries of one folder that a task describes; a pack of further names; a task's least share of a round.
CUT, PACK, SHARE = 4096, 1024, 4096
#: Shares per core of a round, so that slow tasks leave something to the others.
SPREAD = 2
#: Bytes of a folder's own size that are taken for one entry.
ENTRY_BYTES = 512

ENTRY = [("rel_path", pa.string()), ("size", pa.int64()), ("is_file", pa.bool_()), ("modified", pa.int64())]
#: What a round gives: entries, and (work is not null) folders or packs of names for the next one.
ROUND = [*ENTRY, ("task", pa.int64()), ("before", pa.int64()), ("work", pa.int64()), ("state", pa.list_(pa.string())), ("names", pa.list_(pa.string()))]
SCHEMA = "rel_path string, size bigint, is_file boolean, modified bigint"
ROUND_SCHEMA = f"{SCHEMA}, task bigint, before bigint, work bigint, state array<string>, names array<string>"


def is_folder(path: str, entry: os.DirEntry | None) -> bool:
    """Whether a path is a folder and no link to one; mostly known without asking the file system."""
    if entry is not None:
        return entry.is_dir(follow_symlinks=False)
    return os.path.isdir(path) and not os.path.islink(path)


class Lister:
    """What one task of a round does."""

    def __init__(self, root: str, pruner: Pruner, task: int, share: int):
        self.root, self.pruner, self.task, self.share = root, pruner, task, share
        self.done = self.before = 0
        self.stack: list[tuple[str, State, int]] = []
        self.rows: list[tuple] = []

    def path(self, rel: str, name: str) -> str:
        return f"{rel}/{name}" if rel else name

    def describe(self, rel: str, name: str, state: State, entry: os.DirEntry | None = None) -> None:
        """An entry's row; a folder that has to be entered goes on the stack."""
        own = self.pruner.step(state, name)
        path = self.path(rel, name)
        full = os.path.join(self.root, path)
        excluded, barren = self.pruner.excludes(own, name), self.pruner.barren(own, name)
        if excluded and (barren or not is_folder(full, entry)):
            return
        self.done += 1
        try:
            found = os.lstat(full)
            link = stat.S_ISLNK(found.st_mode)
            found = os.stat(full) if link else found
            is_file, size, modified = stat.S_ISREG(found.st_mode), found.st_size, found.st_mtime_ns
            if stat.S_ISDIR(found.st_mode) and not link and not barren:
                self.stack.append((path, own, max(1, min(CUT, size // ENTRY_BYTES))))
        except OSError:  # a dangling link: present, but no file
            is_file, size, modified = False, 0, None
        if not excluded:
            self.rows.append((path, size, is_file, modified, None, None, None, None, None))

    def later(self, rel: str, state: State, work: int, names: list[str] | None) -> None:
        """A folder or a pack for the next round."""
        self.rows.append((rel, None, None, None, self.task, self.before, work, [format(x, "x") for x in state], names))
        self.before += work

    def list(self, rel: str, state: State) -> None:
        """The entries of a folder; nothing if it can't be read, unless it is the root."""
        seen, pack = 0, []
        try:
            with os.scandir(os.path.join(self.root, rel)) as found:
                for entry in found:
                    seen += 1
                    if seen <= CUT:
                        self.describe(rel, entry.name, state, entry)
                        continue
                    pack.append(entry.name)
                    if len(pack) == PACK:
                        self.later(rel, state, PACK, pack)
                        pack = []
        except OSError:
            if not rel:
                raise
        if pack:
            self.later(rel, state, len(pack), pack)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            cols = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, ROUND, strict=True)], names=[n for n, _ in ROUND])
            self.rows = []

    def run(self, given: Iterable[tuple[str, State, list[str] | None]]) -> Iterator[pa.RecordBatch]:
        for rel, state, names in given:
            if names is None:
                self.list(rel, state)
            else:
                for name in names:
                    self.describe(rel, name, state)
            yield from self.batches(10_000)
        while self.stack and self.done < self.share:
            rel, state, _ = self.stack.pop()
            self.list(rel, state)
            yield from self.batches(10_000)
        for rel, state, work in self.stack:
            self.later(rel, state, work, None)
            yield from self.batches(10_000)
        yield from self.batches()


def listed(frontier: DataFrame, root: str, pruner: Pruner, share: int) -> DataFrame:
    """One round over rows (rel_path, state, names): see ROUND."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((r, tuple(int(x, 16) for x in s), n) for b in batches for r, s, n in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield from Lister(root, pruner, TaskContext.get().partitionId(), share).run(given)

    return frontier.select("rel_path", "state", "names").mapInArrow(run, ROUND_SCHEMA)


def listing(spark: SparkSession, directory: str, exclude: Sequence[str] = (), include_hidden: bool = True, times: bool = False) -> DataFrame:
    """Staged entries below a directory that aren't excluded: rel_path, size, is_file (and modified, in ns)."""
    root, pruner = mounted(directory), Pruner(exclude, not include_hidden)
    first = spark.createDataFrame([("", [format(x, "x") for x in pruner.start], None)], "rel_path string, state array<string>, names array<string>")
    paths, frontier, share = [], first.coalesce(1), SHARE
    cores = spark.sparkContext.defaultParallelism
    while True:
        paths.append(scratch(spark, "listing"))
        listed(frontier, root, pruner, share).write.parquet(paths[-1])
        left = spark.read.schema(ROUND_SCHEMA).parquet(paths[-1]).where("work IS NOT NULL")
        sums = left.groupBy("task").agg(F.sum("work").alias("work")).orderBy("task").collect()  # a row per task
        total = sum(r["work"] for r in sums)
        if not total:
            break
        share = max(SHARE, -(-total // (cores * SPREAD)))
        starts, before = [], 0
        for r in sums:
            starts.append((r["task"], before))
            before += r["work"]
        placed = left.join(F.broadcast(spark.createDataFrame(starts, "task bigint, start bigint")), "task")  # a row per task
        frontier = placed.repartitionById(-(-total // share), F.floor((F.col("start") + F.col("before")) / share).cast("int"))
    return spark.read.schema(ROUND_SCHEMA).parquet(*paths).where("work IS NULL").select("rel_path", "size", "is_file", *["modified"] * times)


def hidden(rel_path: Column) -> Column:
    """Whether a segment of the path starts with a dot."""
    return rel_path.rlike(r"(^|/)\.")


def excluded(rel_path: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern, anchored at the root of the scan, matches; dots are nothing special."""
    out = F.lit(False)
    for p in patterns:
        out = out | rel_path.rlike(glob_regex(p, dot=True))
    return out


def visible(files: DataFrame, config: Config) -> DataFrame:
    out = files.where(~excluded(F.col("rel_path"), config.exclude_patterns))
    return out if config.include_hidden else out.where(~hidden(F.col("rel_path")))


def with_scan_index(files: DataFrame) -> DataFrame:
    """Number files in the binary order of ``rel_path`` without sorting in one task.

    Indices grow with the path; they are not dense.  The result is staged, since a listing
    must not be repeated once files move.
    """
    return staged(files.orderBy("rel_path").withColumn("scan_index", F.monotonically_increasing_id()), "files")


def scan(spark: SparkSession, directory: str, config: Config) -> DataFrame:
    """FILES: scan_index, original_path, rel_path, filename, extension, size, category,
    target_folder, needs_rename, suggested_name."""
    found = listing(spark, directory, config.exclude_patterns, config.include_hidden).where("is_file").select("rel_path", "size")
    named = with_names(visible(found, config)).withColumn("original_path", join(clean(directory), F.col("rel_path")))
    done = with_suggestions(classify(named, config.categories), config)
    return with_scan_index(done).select(
        "scan_index", "original_path", "rel_path", "filename", "extension", "size", "category", "target_folder", "needs_rename", "suggested_name"
    )
