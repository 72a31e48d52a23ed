"""Incremental scans against differences of full scans; restarts; counts with retractions."""

import collections
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from shelfmark import config as c
from shelfmark.operators import planning, summary
from shelfmark.sources import inventory
from shelfmark.streaming import changes, counts


def scanned(root):
    out = {}
    for folder, folders, files in os.walk(root):
        for n in folders + files:
            full = os.path.join(folder, n)
            rel = os.path.relpath(full, root)
            if not rel.startswith(".") and "/." not in rel and not rel.startswith("skip/"):
                s = os.stat(full)
                out[rel] = (s.st_size, os.path.isfile(full), s.st_mtime_ns)
    return out


def difference(version, old, new):
    rows = collections.Counter()
    for path in {*old, *new}:
        if old.get(path) != new.get(path):
            kind = "added" if path not in old else "gone" if path not in new else "changed"
            rows.update([(version, kind, -1, path, *old[path])] if path in old else [])
            rows.update([(version, kind, 1, path, *new[path])] if path in new else [])
    return rows


def mutate(root, rng):
    files = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names]
    for f in rng.sample(files, len(files) // 4):
        os.remove(f)
    for f in rng.sample(files, len(files) // 4):
        if os.path.exists(f):
            with open(f, "a") as out:
                out.write("more")
    for _ in range(30):
        folder = os.path.join(root, rng.choice(["a", "b/c", "skip/d", ".h", f"n{rng.randint(0, 9)}"]))
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"f{rng.randint(0, 40)}.{rng.choice(['txt', 'jpg', 'xyz'])}"), "w") as out:
            out.write("x" * rng.randint(0, 5))


def test_three_polls_and_a_restart(spark, tmp_path):
    rng, root, state = random.Random(2), tmp_path / "tree", str(tmp_path / "state")
    os.makedirs(root / "a")
    before, expected = {}, collections.Counter()

    def run():
        query = changes.changes(spark, state).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        query.trigger(availableNow=True).start().awaitTermination()

    for version in (1, 2, 3):
        mutate(root, rng)
        assert changes.Watch(spark, str(root), state, ("skip/**",)).poll() == version  # a new object each time
        now = scanned(root)
        expected += difference(version, before, now)
        before = now
        if version == 2:
            os.makedirs(f"{state}/changes/{3:012d}")  # what a poll that died left behind
            with open(f"{state}/changes/{3:012d}/part-x.parquet", "w") as f:
                f.write("junk")
        if version != 1:
            run()  # the first run has two versions, each later one goes on after the one before
    run()
    rows = collections.Counter(tuple(r[n] for n in changes.FIELDS) for r in spark.read.schema(changes.SCHEMA).parquet(str(tmp_path / "out")).collect())
    assert rows == expected and {k for _, k, *_ in rows} == {"added", "changed", "gone"}
    assert sorted(os.listdir(f"{state}/snapshots")) == [f"{v:012d}" for v in (2, 3)]


def test_nothing_changed(spark, tmp_path):
    os.makedirs(tmp_path / "tree/x")
    watch = changes.Watch(spark, str(tmp_path / "tree"), str(tmp_path / "state"))
    assert (watch.poll(), watch.poll()) == (1, 2)
    shutil.rmtree(tmp_path / "tree/x")
    assert watch.poll() == 3 and changes.versions(str(tmp_path / "state")) == [1, 2, 3]
    rows = [spark.read.parquet(watch.path("changes", v)).select("kind", "rel_path").collect() for v in (1, 2, 3)]
    assert rows == [[("added", "x")], [], [("gone", "x")]]


@pytest.mark.parametrize("top", [2])
def test_counts_equal_a_recount(spark, tmp_path, monkeypatch, top):
    """Categories, their first paths and operation types after each of four polls."""
    monkeypatch.setattr(counts, "TOP", top)
    rng, root, config = random.Random(4), str(tmp_path / "tree"), c.Config()
    os.makedirs(f"{root}/a")
    watch, running = changes.Watch(spark, root, str(tmp_path / "state")), counts.Counts(spark, str(tmp_path / "counts"))
    for step in range(4):
        if step == 3:
            shutil.rmtree(f"{root}/a", ignore_errors=True)  # many first paths at once
        else:
            mutate(root, rng)
        watch.poll()
        signed = changes.changes(spark, str(tmp_path / "state")).where("is_file").select("rel_path", "sign")
        running.drain(counts.labelled(signed, config, root))
        files = inventory.scan(spark, root, config)
        first = files.groupBy(summary.category_label(F.col("category")).alias("label")).agg(F.min("rel_path").alias("first"))
        expected = {("category", r.category, r.n) for r in summary.category_summary(files).collect()}
        expected |= {("operation", r.type, r.n) for r in summary.operation_type_counts(planning.plan_operations(files, config, root)).collect()}
        got = running.current().collect()
        assert {(r.kind, r.label, r.n) for r in got} == expected
        assert {r.label: r["first"] for r in got if r.kind == "category"} == {r.label: r["first"] for r in first.collect()}
