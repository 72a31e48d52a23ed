"""Listing by rounds: equal rows on skewed trees, equal shares, folders that are never opened."""

import collections
import os
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from shelfmark import config as c
from shelfmark.functions.globs import glob_regex
from shelfmark.functions.pruning import Pruner
from shelfmark.sources import inventory

PATTERNS = [
    ("**/node_modules/**",), ("a/*/b/**",), ("node_modules/**", ".git/**", "*.js"), ("!src/**",), ("!{src,lib}/**/*.py", "**/b"), ("**",), ("a/*", "a/*/**"), ("*/*",),
    ("{a,src}/[bc]*/**", "**/.*"), ("**/b/**/c*/**",), ("+(a|b)/**", "!(src|lib)/x*"), ("a/+(b/c|x)",), ("!**/*.py", "!a/**"), (), ("src/**/", "*.?s"),
]
NAMES = ["a", "b", "c1", "src", "lib", "node_modules", ".git", "x.js", "y.py", ".h"]


def paths_of(root):
    return {os.path.relpath(os.path.join(d, x), root) for d, folders, files in os.walk(root) for x in folders + files}


def plain(paths, patterns, hidden):
    """What the whole-path expressions leave."""
    own = [re.compile(glob_regex(p, dot=True)) for p in patterns]
    return {p for p in paths if not any(r.search(p) for r in own) and not (hidden and re.search(r"(^|/)\.", p))}


def random_tree(root, seed):
    rng = random.Random(seed)
    for _ in range(120):
        parts = [rng.choice(NAMES) for _ in range(rng.randint(1, 5))]
        folder = os.path.join(root, *parts[:-1])
        try:
            os.makedirs(folder, exist_ok=True)
            open(os.path.join(folder, parts[-1]), "w").close()
        except OSError:  # a file is in the way
            pass


@pytest.mark.parametrize("hidden", [False, True])
@pytest.mark.parametrize("patterns", PATTERNS)
def test_automaton_equals_filter(tmp_path, patterns, hidden):
    """Rows are those of the filter (but for segments that can't be told apart), and barren folders have none below."""
    random_tree(tmp_path, len(str(patterns)))
    paths = paths_of(tmp_path)
    left = plain(paths, patterns, hidden)
    lister = inventory.Lister(str(tmp_path), Pruner(patterns, hidden), 0, 1 << 30)
    got = {p for batch in lister.run([("", lister.pruner.start, None)]) for p in batch.column(0).to_pylist()}
    assert got == left if "/c|x" not in str(patterns) else got >= left
    pruner = Pruner(patterns, hidden)
    for path in paths:
        state = pruner.start
        for name in path.split("/"):
            state = pruner.step(state, name)
        if pruner.barren(state, name):
            assert not any(p.startswith(path + "/") for p in left)


@pytest.mark.parametrize("patterns,never", [
    (("**/node_modules/**",), "node_modules"), (("a/*/b/**",), "b"), (("!src/**",), "lib"), (("a/*/b/*", "a/*/b/*/**"), "b"), (("{x,a/?/b}/**",), "b"),
])
def test_pruned_folders_are_not_opened(tmp_path, monkeypatch, patterns, never):
    for path in ("a/1/b/deep/er", "a/2/b", "src/node_modules/x", "src/lib" if never != "lib" else "src/y", "lib/z"):
        os.makedirs(tmp_path / path)
        (tmp_path / path / "f.txt").write_text("x")
    opened, described, scandir, lstat = [], [], os.scandir, os.lstat
    monkeypatch.setattr(inventory.os, "scandir", lambda p: opened.append(os.path.relpath(p, tmp_path)) or scandir(p))
    monkeypatch.setattr(inventory.os, "lstat", lambda p, *a, **k: described.append(os.path.relpath(p, tmp_path)) or lstat(p, *a, **k))
    lister = inventory.Lister(str(tmp_path), Pruner(patterns), 0, 1 << 30)
    rows = [p for batch in lister.run([("", lister.pruner.start, None)]) for p in batch.column(0).to_pylist()]
    monkeypatch.undo()
    assert set(rows) == plain(paths_of(tmp_path), patterns, False) and len(opened) > 1
    assert not any(never in p.split("/") for p in opened) and not any(f"/{never}/" in f"/{p}" for p in described)


@pytest.fixture
def skewed(tmp_path):
    """One folder of 20,000 files, a chain of 200 folders, and 400 small folders."""
    os.makedirs(tmp_path / "big")
    for i in range(20_000):
        open(tmp_path / f"big/f{i:05d}.txt", "w").close()
    chain = tmp_path / "chain"
    for i in range(200):
        chain /= f"c{i}"
        chain.mkdir(parents=True)
        (chain / "x.md").write_text("x" * i)
    for i in range(400):
        os.makedirs(tmp_path / f"w{i}/sub")
        (tmp_path / f"w{i}/sub/q.py").write_text("")
    return tmp_path


def test_shares(spark, skewed, monkeypatch):
    monkeypatch.setattr(inventory, "CUT", 512)
    monkeypatch.setattr(inventory, "PACK", 128)
    monkeypatch.setattr(inventory, "SHARE", 1000)
    got = inventory.listing(spark, str(skewed))
    rows = got.select("rel_path", "size", "is_file", F.col("_metadata.file_path").alias("file")).collect()
    assert collections.Counter(r.rel_path for r in rows) == collections.Counter(paths_of(skewed))
    assert all(r["size"] == os.stat(skewed / r.rel_path).st_size and r.is_file == os.path.isfile(skewed / r.rel_path) for r in rows)
    tasks = collections.defaultdict(collections.Counter)  # a task writes one file
    for r in rows:
        folder, _, name = r.file.rpartition("/")
        tasks[folder][name] += 1
    wide = [list(n.values()) for n in tasks.values() if len(n) > 3]
    assert wide and all(max(n) <= 2 * statistics.median(n) for n in wide)
    assert max(max(n.values()) for n in tasks.values()) < len(rows) / 4 and len(tasks) < 10


def test_scan_prunes(spark, skewed):
    config = c.Config(exclude_patterns=("big/**", "**/sub/**", "chain/c0/c1/c2/**"))
    files = inventory.scan(spark, str(skewed), config)
    assert sorted(r.rel_path for r in files.collect()) == ["chain/c0/c1/x.md", "chain/c0/x.md"]


def test_unreadable(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        inventory.listing(spark, str(tmp_path / "none"))
    assert inventory.listing(spark, str(tmp_path)).count() == 0
