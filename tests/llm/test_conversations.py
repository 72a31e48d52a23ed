"""Conversation repair against a plain table over all nodes of the lattice."""

import collections
import hashlib
import itertools
import zlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import conversations as c

SF = "/root/testdata/sf0.001"
LEGAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """Dynamic programming over rows; rows are (initial, goes, truncated)."""
    def inserted(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                best[NEXT[q]] = min(best.get(NEXT[q], (1 << 60, "")), (cost + 5, audit + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, goes, cut in rows:
        new = {}
        for q, (cost, audit) in best.items():
            ways = [(q, cost + 2, "D")]
            if not goes:
                ways.append((NEXT[q], cost + 1 + 5 * cut, "R"))
                if (q, initial) in LEGAL:
                    ways.append((LEGAL[q, initial], cost + 5 * cut, "K"))
            for to, n, edit in ways:
                new[to] = min(new.get(to, (1 << 60, "")), (n, audit + edit))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def digest(conv, role, text):
    """What orders rows of one turn and role."""
    size, name = (-1, "") if conv is None else (len(str(conv)), conv)
    return hashlib.sha256(f"{size}:{len(role)}:{name}:{role}:{text}".encode()).digest()


def brute(rows):
    out, after = {}, damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(conv, r[1], r[2])))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults, strict=True)])
        lines, rest, before = [], iter(own), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[1:]
            if edit in "RI":
                role = "assistant" if before == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
                before = role[:1]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=9), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_search(rows, portion):
    """One search, searches by portions, and parts walked from every state give the table's answer."""
    expected = cheapest(rows)
    assert list(c.search(rows, {0: (0, "")}, True).values()) == [expected]
    walk = c.Walk(0)
    for i in range(0, len(rows), portion):
        walk.advance(rows[i : i + portion])
    assert min((w["cost"], w["audit"]) for w in walk.ways() if w["exit"] in c.ACCEPTING or not rows) == expected
    cut = len(rows) // 2
    parts = [c.Part("x", (0, 1, 2, 3)) for _ in range(2)]
    for k, (initial, goes, truncated) in enumerate(rows):
        parts[k >= cut].add(k, initial, "blank" if goes else "truncated" if truncated else None)
    if cut:
        got = c.folded([p.row(i, False) for i, p in enumerate(parts)])
        assert (got["cost"], got["audit"], got["gaps"]) == (*expected, 0)


def rows_of(spark, folder):
    got = c.op12_conversation_repair(spark, str(folder))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert [t for _, t in got.dtypes[1:7]] == ["bigint"] * 6
    return {r.conv_id: tuple(r) for r in got.collect()}


def test_op12(spark):
    table = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    assert rows_of(spark, SF) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table])


def test_odd_conversations(spark, tmp_path):
    """Nulls, ties, repeated rows, other roles, gaps, white space, a conversation in many portions, clashing columns."""
    rows = [(1, t, r, "A sentence.") for t, r in enumerate(["system", "user", "user", "assistant", "tool", "user"])]
    rows += [(1, 50, "assistant", "Far away."), (1, 50, "assistant", "Far away."), (1, 50, "user", "Tied."), (None, None, None, None), (None, 3, "user", "Null id?"), (None, None, "assistant", "x")]
    rows += [(2, t, None, " \t\x0b ") for t in range(5)] + [(3, t, "", "\n \r\n") for t in range(4)] + [(4, 7, "Üser", "Wörter! \n")]
    rows += [(5, t, ("user", "assistant")[t % 2], f"Turn {t // 3}" + "." * (t % 5 > 0)) for t in range(900)] + [(6, t, "user", "Same.") for t in range(300)]
    rows += [(7, 0, "user", "long " * 400_000 + "."), (7, 1, "assistant", "Yes.")] + [(100 + i, 0, "user", "x") for i in range(60)]
    schema = "conv_id bigint, turn bigint, role string, text string, rid int, key int, `a.b` int, fault int"
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(spark, tmp_path)
    assert got == brute(rows) and any(len(r[7]) == 0 and r[6] == 0 for r in got.values())
    turns, done = c.analysed(c.damaged(spark.read.parquet(str(tmp_path / "conversations.parquet"))))
    out = collections.defaultdict(list)
    for r in sorted(c.repaired(turns, done).collect(), key=lambda r: (str(r.conv_id), r.place)):
        out[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, row in got.items():
        assert hashlib.sha256("\n".join(out[conv]).encode()).hexdigest() == row[8]


@pytest.mark.parametrize("partitions", [1, 7])
def test_conversation_over_partitions(spark, tmp_path, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(1, t, ("user", "assistant", "system")[t * t % 3], f"{t % 40}." if t % 3 else f"{t}") for t in range(3000)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert rows_of(spark, tmp_path) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(spark, tmp_path) == {}
