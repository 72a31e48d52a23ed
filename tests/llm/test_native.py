"""Exact dedup, mixing and sharding against brute force, on the cases that are easy to get wrong."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import exact_dedup, mixing, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size int, key int"


def docs(spark, rows, tmp_path=None):
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2) for i, t, s in rows], DOCS)
    if tmp_path:
        df.repartition(3).write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    return df


ROWS = [
    (1, "a b", "s"), (2, "a b", "s"), (7, "a b", None), (3, None, "s"), (4, "", "t"), (5, "unique", "t"), (5, "unique", "t"), (None, "unique", "t"),
    (None, "only null", "t"), (9, "A b", "u"), (10, "long " * 20_000, "u"), (11, "long " * 20_000, "u"),
]


@pytest.mark.parametrize("files", [True, False])
def test_exact_dedup(spark, tmp_path, files):
    got = exact_dedup.exact_dedup(docs(spark, ROWS, tmp_path if files else None)).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    expected = collections.Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t, _ in ROWS)
    assert collections.Counter((r.id, r.keep_id, r.group_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups) and all(r.id == r.keep_id for r in got if r.kept)


def test_exact_dedup_compares_bytes(spark):
    """Under a digest that collides, texts are still told apart by their bytes."""
    rows = [(1, "aa", "s"), (2, "bb", "s"), (3, "aa", "s"), (4, "ccc", "s")]
    got = exact_dedup.exact_dedup(docs(spark, rows), digest=lambda t: F.length(t).cast("string"))
    assert {r.id: (r.keep_id, r.group_size) for r in got.collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_exact_dedup_keeps_columns(spark):
    for df in (docs(spark, ROWS), docs(spark, [])):
        out = exact_dedup.keep_unique(df)
        assert out.schema == df.schema
        assert out.count() == len({t or "" for _, t, _ in ROWS}) * (df.count() > 0)


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-6 and open_:
        total, excess = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * w[s] / total
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = excess
    return target


@pytest.mark.parametrize("edge_rows", [20_000, 2])
def test_mixing(spark, edge_rows, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge_rows)
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["é", "b", "a", None, "𐀀", "￿"][i * i % 6] if i % 3 else "b") for i in range(300)]
    rows += [(1000, None, "a"), (1001, "x\ty\rz", "a"), (1001, "x\ty\rz", "a"), (None, "q r", "b")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken >= r.epochs * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(target[s] + 1e-6) for s in sizes)
    for s in sizes:  # those beyond complete epochs come first by key, and one at most is cut
        own = sorted((r for r in got if r.source == s and r["size"]), key=lambda r: r.es_key)
        more = [(r.taken - r.epochs * r["size"]) / r["size"] for r in own]
        assert more == sorted(more, reverse=True) and sum(0 < m < 1 for m in more) <= 1
    assert sorted(map(str, mixing.mix(docs(spark, rows)).collect())) == sorted(map(str, got))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixed_rows(spark):
    rows = [(i, f"w{i} " + "v " * (i % 9), "ab"[i % 2]) for i in range(60)]
    df = docs(spark, rows)
    plan = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(df).collect()}
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert dict((i, t) for i, t, _ in rows)[r.doc_id].startswith(r.text)
    assert {i: t for i, (t, _) in plan.items() if t} == dict(words)


def test_mixed_rows_whole(spark):
    rows = [(i, f"w{i} " + "v " * (i % 9), "ab"[i % 2]) for i in range(60)] + [(60 + i, "x " * 400, s) for i, s in enumerate("cccd")]
    rows += [(64, "", "a"), (65, None, "d")]
    df = docs(spark, rows)
    expected = collections.Counter()
    for r in mixing.mix(df).collect():
        full, part = divmod(r.taken, r["size"]) if r["size"] else (0, 0)
        expected[r.doc_id] += full + (2 * part >= r["size"] > 0)
    texts = {i: t for i, t, _ in rows}
    got = collections.Counter()
    for r in mixing.mixed_rows(df, whole=True).collect():
        assert r.text == texts[r.doc_id]
        got[r.doc_id] += 1
    assert got == +expected


def test_weighted_sampling_prefers_quality(spark):
    rows = [(i, "word " * 10 if i % 2 else "#### " * 10, "s") for i in range(2000)]
    got = mixing.mix(docs(spark, rows), share=0.5).collect()
    good = sum(r.taken for r in got if r.doc_id % 2) / sum(r.taken for r in got)
    # weights 1 and 0.2: where half of all is taken, (1 - exp(-t)) + (1 - exp(-t / 5)) = 1
    assert abs(good - 0.755) < 0.03


@pytest.mark.parametrize("limit", [50, 400, 10**9])
def test_sharding(spark, limit):
    rows = [(i, "x" * (i * 13 % 60), "s") for i in range(400)] + [(7, "y" * 30, "s")] * 20 + [(None, None, "s"), (1, "z" * 500, "s")]
    got = sharding.shard(docs(spark, rows), limit).collect()
    assert len(got) == len(rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for prefix, own in shards.items():
        total = sum(r.n_bytes for r in own)
        assert {(r.shard_bytes, r.shard_rows, r.depth) for r in own} == {(total, len(own), len(prefix))}
        assert (total <= limit) != own[0].over_limit and (total <= limit or len(own) == 1)
        # a bucket was split only because it was too large
        parent = [r for q, rs in shards.items() if prefix and q.startswith(prefix[:-1]) for r in rs]
        assert not prefix or sum(r.n_bytes for r in parent) > limit
        assert not any(q != prefix and q.startswith(prefix) for q in shards)
    assert sharding.shard(docs(spark, []), limit).count() == 0
