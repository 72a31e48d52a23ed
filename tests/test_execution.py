"""Executing in tasks against executing in order; probes of target folders only."""

import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import conflicts, existence
from shelfmark.operators.execution import execute, perform

SCHEMA = "scan_index bigint, type string, original_path string, new_path string, reason string"


def refuses(source, target):
    """Fails for names with a bad letter, as a file without permission would."""
    if "!" in os.path.basename(source):
        raise PermissionError(f"denied: {source}")
    os.rename(source, target)


def in_order(ops):
    out = {}
    for i, _, source, target, _ in sorted(ops):
        try:
            perform(source, target, refuses)
            out[i] = ("success", None)
        except Exception as error:
            out[i] = ("failed", str(error))
    return out


def made(root, rng):
    """Many cases, each a folder with chains, cycles, collisions, missing sources, sources that can't be moved."""
    ops = []
    for case in range(120):
        names = [f"{root}/{case}/{k}{'!' * (rng.random() < 0.25)}" for k in range(9)]
        os.makedirs(f"{root}/{case}")
        sources = rng.sample(names, rng.randint(1, 7))
        for n in {*sources, *[n for n in names if rng.random() < 0.15]}:
            if n not in sources or rng.random() > 0.0:
                open(n, "w").write(n)
        ops += [(case * 100 + i, "move", s, rng.choice([n for n in names if n != s]), "r") for i, s in enumerate(sources)]
    return ops


@pytest.mark.parametrize("seed", [1, 2])
def test_tasks_do_what_order_does(spark, tmp_path, seed):
    one, two = tmp_path / "tree", tmp_path / "kept"
    ops = made(str(one), random.Random(seed))
    done = execute(spark.createDataFrame(ops, SCHEMA).repartition(6), rename=refuses)
    got = {r.scan_index: (r.status, r.error) for r in done.collect()}
    left = {os.path.relpath(os.path.join(d, n), one): open(os.path.join(d, n)).read() for d, _, names in os.walk(one) for n in names}
    os.rename(one, two)
    made(str(one), random.Random(seed))
    assert got == in_order(ops)
    assert left == {os.path.relpath(os.path.join(d, n), one): open(os.path.join(d, n)).read() for d, _, names in os.walk(one) for n in names}
    assert {s for s, _ in got.values()} == {"success", "failed"} and any("denied" in (e or "") for _, e in got.values())


def test_long_chain(spark, tmp_path):
    for i in range(60):
        (tmp_path / str(i)).write_text(str(i))
    ops = [(i, "rename", f"{tmp_path}/{i}", f"{tmp_path}/{i - 1}", "r") for i in range(60)]  # 0 makes room for 1, and so on
    done = execute(spark.createDataFrame(ops, SCHEMA))
    assert done.where("status = 'success'").count() == 60
    assert all((tmp_path / str(i - 1)).read_text() == str(i) for i in range(60))


def test_repeated_task(tmp_path):
    (tmp_path / "a").write_text("x")
    perform(f"{tmp_path}/a", f"{tmp_path}/d/b")
    perform(f"{tmp_path}/a", f"{tmp_path}/d/b", again=True)
    with pytest.raises(FileExistsError):
        perform(f"{tmp_path}/a", f"{tmp_path}/d/b")


@pytest.mark.parametrize("filtered,broadcast", [(1000, 100_000), (3, 100_000), (3, 5)])
def test_probe_reads_target_folders_only(spark, tmp_path, monkeypatch, filtered, broadcast):
    monkeypatch.setattr(existence, "FILTERED", filtered)
    monkeypatch.setattr(existence, "BROADCAST", broadcast)
    present = spark.range(20_000).select(F.concat(F.lit("/base/d"), F.format_string("%03d", F.col("id") % 200), F.lit("/f"), F.col("id").cast("string")).alias("path"))
    ops = spark.range(40).select(F.col("id").alias("scan_index"), F.lit("/x").alias("original_path"), F.format_string("/base/d%03d/f%d", F.col("id") % 10, F.col("id") * 5).alias("new_path"))
    table = existence.PathTable(spark, str(tmp_path / "paths")).write(present)
    for near in (table.near(ops), existence.near_targets(present, ops)):
        assert near.count() == 1000  # ten folders of a hundred
        got = {r.scan_index: r.target_exists for r in conflicts.with_target_exists(ops, near).collect()}
        assert got == {i: i * 5 % 200 == i % 10 for i in range(40)} and any(got.values())
    assert existence.near_targets(present, ops.limit(0)).count() == 0


def test_present_on_disk(spark, tmp_path):
    os.makedirs(tmp_path / "images/deep")
    (tmp_path / "images/a.jpg").write_text("")
    (tmp_path / "documents").write_text("a file in a folder's place")
    ops = spark.createDataFrame([(1, "move", "/s", f"{tmp_path}/images/b.jpg", ""), (2, "move", "/t", f"{tmp_path}/documents/c", ""), (3, "move", "/u", f"{tmp_path}/new/d", "")], SCHEMA)
    got = {r.path.removeprefix(f"{tmp_path}/"): r.is_file for r in existence.on_disk(ops).collect()}
    assert got == {"images": False, "images/deep": False, "images/a.jpg": True, "documents": True}
    assert execute(ops.where("scan_index = 2")).first().error == conflicts.BLOCKED + f"{tmp_path}/documents"
