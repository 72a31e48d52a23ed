"""Repairing the structure of conversations at least cost.

A conversation's rows, in their order, have faults: blank, a duplicate of an earlier row, truncated.  Edits
keep a row, change its role, delete it or insert an empty turn; the roles of what is left have to be
``(system? (user assistant)+)?``.  The cheapest edits are a shortest path in the lattice of nodes (turn
index, grammar state), which is never built: Dijkstra's algorithm with the key (cost, audit), audit being
the edits' initials so far, expands what it pops and ends at the first accepting end node popped.

Scale.  Rows are sorted by range, so a long conversation lies in several partitions.  A partition walks
its rows in portions of ``PORTION``: the best (cost, audit) of each grammar state after one portion are the
sources of the next (audits lose what all states have in common, so they stay short).  The first
conversation of a partition may have begun before it; it is walked from each state.  A partition's part of a conversation is then one row: for
each pair of states the cheapest way; and the parts of a conversation are folded to its audit.  No task
holds a conversation; the texts aren't moved until the edits are known.  Duplicates are found by digests of (role,
text) and aggregation; hot digests are salted.  ``repaired`` streams the rows of a conversation beside its audit.  Its
SHA-256 has no parallel form: the rows of one conversation pass through one task, in constant memory.

Defined cases: the order is by turn (nulls first), then role, then a digest of the row; a null identifier is one conversation; null roles and texts
are one space; without rows there is nothing to edit; repeated rows are duplicates; roles of any other kind have
to go or to change; texts of any length pass; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.batches import staged_in_small_batches
from shelfmark.llm.common import col, members_bitmap, spread_join, staged, with_maybe

#: Grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 accept.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after a changed or inserted turn, whose role follows from the state before.
MADE = (2, 2, 3, 2)
ACCEPTING = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows that one search goes through.
PORTION = 256
SPACE = " \t\n\x0b\x0c\r"

Sources = dict[int, tuple[int, str]]


def search(rows: list[tuple[str, bool, bool]], sources: Sources, whole: bool) -> Sources:
    """The least (cost, audit) of the states after ``rows`` (initial, has to go, truncated).

    ``whole``: nothing follows, so the first accepting node popped is the answer.
    """
    heap = [(cost, audit, 0, state) for state, (cost, audit) in sources.items()]
    heapq.heapify(heap)
    done, out, end = set(), {}, len(rows)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == end:
            out[state] = cost, audit
            if whole and state in ACCEPTING:
                return {state: out[state]}
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, MADE[state]))
        if i < end:
            initial, goes, cut = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not goes:
                stays = cost + TRUNCATED * cut
                if (state, initial) in STEPS:
                    heapq.heappush(heap, (stays, audit + "K", i + 1, STEPS[state, initial]))
                heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, MADE[state]))
    return out


class Walk:
    """The cheapest edits of consecutive rows from one entry state on."""

    def __init__(self, entry: int):
        self.entry, self.front, self.common = entry, {entry: (0, "")}, []

    def advance(self, rows: list[tuple[str, bool, bool]], whole: bool = False) -> None:
        self.front = search(rows, self.front, whole)
        shared = len(os.path.commonprefix([audit for _, audit in self.front.values()]))
        if shared:
            self.common.append(next(iter(self.front.values()))[1][:shared])
            self.front = {state: (cost, audit[shared:]) for state, (cost, audit) in self.front.items()}

    def ways(self) -> list[dict]:
        start = "".join(self.common)
        return [{"entry": self.entry, "exit": state, "cost": cost, "audit": start + audit} for state, (cost, audit) in sorted(self.front.items())]


class Part:
    """A partition's rows of one conversation."""

    def __init__(self, conv, entries: Iterable[int]):
        self.conv, self.walks, self.rows = conv, [Walk(e) for e in entries], []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.counts["illegal"] += self.last_initial + initial not in ("su", "ua", "au")
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.counts["turns"] += 1
        self.rows.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        if len(self.rows) >= PORTION:
            self.flush()

    def flush(self, whole: bool = False) -> None:
        for walk in self.walks:
            walk.advance(self.rows, whole)
        self.rows = []

    def row(self, number: int, whole: bool) -> dict:
        self.flush(whole)
        ends = {k: getattr(self, k) for k in ("first_turn", "last_turn", "first_initial", "last_initial")}
        return {"conv_id": self.conv, "part": number, **self.counts, **ends, "ways": [w for walk in self.walks for w in walk.ways()]}


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text after reproducible damage, by crc32 of ``conv_id:turn``."""

    def string(name: str) -> Column:
        return F.coalesce(col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(string(id_col), F.lit(":"), string(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(string(text_col), "[.!?]", "")).otherwise(string(text_col))
    copies = F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0))
    return rows.where(kind != 0).select(
        col(id_col).alias("conv_id"), col(turn_col).cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(string(role_col)).alias("role"),
        text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def faulty(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged turns (conv_id, turn, role, text, rid, key), and the same without text but with ``initial`` and
    ``fault`` (null, blank, duplicate or truncated)."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    sizes = [F.coalesce(F.length(F.col("conv_id").cast("string")), F.lit(-1)).cast("string"), F.length("role").cast("string")]
    digest = F.sha2(F.concat_ws(":", *sizes, conv, "role", "text"), 256)
    trimmed = F.rtrim("text", F.lit(SPACE))
    own = F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    rows = staged(turns.select(
        "*", F.monotonically_increasing_id().alias("rid"), F.unhex(digest).alias("key"), F.substring("role", 1, 1).alias("initial"), own.alias("fault")
    ), "turns")
    light = rows.select("conv_id", "turn", "role", "rid", "key", "initial", "fault")
    place = F.struct("turn", "role", "rid")  # equal keys have equal texts
    groups = light.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = staged(groups.select("key", F.col("first.rid").alias("first"), "n"), "copies")
    flagged = with_maybe(light, members_bitmap(groups, "key"), "key")
    some = spread_join(flagged.where("__maybe").drop("__maybe"), groups, "key", "n")
    again = F.when((F.col("first") != F.col("rid")) & ~F.col("fault").eqNullSafe("blank"), "duplicate").otherwise(F.col("fault"))
    marked = some.withColumn("fault", again).drop("first", "n").unionByName(flagged.where("not __maybe").drop("__maybe"))
    return rows.drop("initial", "fault"), marked


ORDER = ("turn", "role", "key", "rid")
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def folded(parts: Iterable[dict]) -> dict:
    """One conversation from its parts in order."""
    total = dict.fromkeys(COUNTS, 0)
    best: Sources = {0: (0, "")}
    first = last = initial = None
    for p in parts:
        for k in COUNTS:
            total[k] += p[k]
        if initial is not None:
            total["illegal"] += initial + p["first_initial"] not in ("su", "ua", "au")
        initial = p["last_initial"]
        if p["first_turn"] is not None:
            total["turns"] -= last == p["first_turn"]
            first = p["first_turn"] if first is None else first
            last = p["last_turn"]
        following: Sources = {}
        for w in p["ways"]:
            if w["entry"] in best:
                cost, audit = best[w["entry"]]
                way = cost + w["cost"], audit + w["audit"]
                following[w["exit"]] = min(following.get(w["exit"], way), way)
        best = following
    cost, audit = min(best[s] for s in ACCEPTING if s in best)
    gaps = 0 if first is None else last - first + 1 - total["turns"]
    return {"gaps": gaps, **{k: total[k] for k in COUNTS[:4]}, "cost": cost, "audit": audit}


FOLDED = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audits(light: DataFrame) -> DataFrame:
    """conv_id, the counts, cost and audit of every conversation with rows."""
    kind = light.schema["conv_id"].dataType.simpleString()
    ways = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    schema = f"conv_id {kind}, part bigint, {counts}, first_turn bigint, last_turn bigint, first_initial string, last_initial string, ways {ways}"

    arrow = arrow_schema(schema)
    all_ends = arrow_schema(f"conv_id {kind}, {FOLDED}")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, out, begun = TaskContext.get().partitionId(), None, [], False
        for batch in batches:
            for conv, turn, initial, fault in zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True):
                if not begun or part.conv != conv:
                    if begun:
                        out.append(part.row(number, len(part.walks) == 1))
                    part, begun = Part(conv, (0,) if begun else range(4)), True
                part.add(turn, initial, fault)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if begun:
            out.append(part.row(number, False))
            yield pa.RecordBatch.from_pylist(out, arrow)

    placed = light.orderBy("conv_id", *ORDER).select("conv_id", "turn", "initial", "fault")
    parts = staged(placed.mapInArrow(walk, schema), "parts")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if own and own[0]["conv_id"] != row["conv_id"]:
                    out.append({"conv_id": own[0]["conv_id"], **folded(own)})
                    own = []
                own.append(row)
            yield pa.RecordBatch.from_pylist(out, all_ends)
        if own:
            yield pa.RecordBatch.from_pylist([{"conv_id": own[0]["conv_id"], **folded(own)}], all_ends)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(fold, f"conv_id {kind}, {FOLDED}")


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The turns (edit, role, text) that an audit leaves of the turns (role, text)."""
    state, names = 0, {2: "user", 3: "assistant"}
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K":
            state = STEPS[state, role[:1]]
        else:
            state = MADE[state]
            role = names[state]
        yield edit, role, text


def streamed(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Every audit, followed by its conversation's rows in order, each conversation in one partition."""
    light = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "rid", "text", F.lit(None).cast("string").alias("audit"))
    kinds = dict(light.dtypes)
    heads = done.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("turn", "role", "key", "rid", "text")], "audit")
    both = light.unionByName(heads).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", *ORDER).select("conv_id", "kind", "role", "text", "audit")


def conversations_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str, str]]]]:
    """(conv_id, its repaired turns) of streamed rows; a conversation's turns must be read before the next."""
    rows = ((c, k, r, t, a) for b in batches for c, k, r, t, a in zip(*[x.to_pylist() for x in b.columns], strict=True))
    ahead: list[tuple] = []

    def turns() -> Iterator[tuple[str, str]]:
        for row in rows:
            if row[1] == 0:
                ahead.append(row)
                return
            yield row[2], row[3]

    head = next(rows, None)
    while head is not None:
        own = turns()
        yield head[0], edited(head[4], own)
        for _ in own:  # rows after the last edit that is read
            pass
        head = ahead.pop() if ahead else None


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit, role, text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place bigint, edit string, role string, text string"
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, turns in conversations_of(batches):
            for place, (edit, role, text) in enumerate(turns):
                out.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
                size += len(text) + 50
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, arrow)

    return streamed(rows, done).mapInArrow(run, schema)


def digests(rows: DataFrame, done: DataFrame) -> DataFrame:
    """(conv_id, SHA-256 of the repaired ``role:text`` lines)."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv, turns in conversations_of(batches):
            digest, between = hashlib.sha256(), b""
            for _, role, text in turns:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    return streamed(rows, done).mapInArrow(run, schema)


def analysed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(staged turns, staged audits): what ``repaired`` and ``digests`` take."""
    rows, marked = faulty(turns)
    light = staged(marked, "faults")
    done = staged_in_small_batches(audits(light), "audits")
    return rows, done


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows, done = analysed(damaged(table))
    hashed = digests(rows, done).withColumnRenamed("conv_id", "__conv")
    got = done.join(hashed, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    every = table.select(F.col("conv_id").alias("__id")).distinct()
    met = every.join(got, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(
        F.col("__id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


# --- SQL for the same: a table over rows and states; a state's best (cost, audit) is one string ------


def _add(state: str, cost: str, edit: str) -> str:
    return f"lpad(CAST(CAST(left({state}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}, 13) || '{edit}'"


def _step(to: int) -> str:
    """The best of a state after a row: deleted, kept, or with another role."""
    ways = [_add(f"p{to}", str(DELETE), "D")]
    for state in range(4):
        for initial in (x for (s, x), t in STEPS.items() if (s, t) == (state, to)):
            ways.append(f"CASE WHEN NOT goes AND initial = '{initial}' THEN {_add(f'p{state}', f'{TRUNCATED} * cut', 'K')} END")
        if MADE[state] == to:
            ways.append(f"CASE WHEN NOT goes THEN {_add(f'p{state}', f'{REROLE} + {TRUNCATED} * cut', 'R')} END")
    return f"least({', '.join(ways)}, NULL)"


def _inserted(source: str) -> str:
    """Turns inserted after a row."""
    two = f"least(p2, {', '.join(_add(f'p{q}', str(INSERT), 'I') for q in (0, 1, 3))})"
    return f"SELECT * EXCLUDE (two) REPLACE (two AS p2, least(p3, {_add('two', str(INSERT), 'I')}) AS p3) FROM (SELECT *, {two} AS two FROM ({source}))"


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_BYTE = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
_START = "SELECT CAST(0 AS BIGINT) AS i, conv_id, n, '000000000000' AS p0, CAST(NULL AS VARCHAR) AS p1, CAST(NULL AS VARCHAR) AS p2, CAST(NULL AS VARCHAR) AS p3 FROM counts"
_NEXT = f"SELECT b.i + 1 AS i, b.conv_id, n, {', '.join(f'{_step(q)} AS p{q}' for q in range(4))} FROM best b JOIN marked m ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = b.i + 1"
ORACLE = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({_KEY}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: {_BYTE}), 4294967295) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM t WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
    sha256(coalesce(length(CAST(conv_id AS VARCHAR)), -1) || ':' || length(role) || ':' || coalesce(CAST(conv_id AS VARCHAR), '') || ':' || role || ':' || text), copy) AS i FROM d),
seen AS (SELECT *, left(role, 1) AS initial, rtrim(text, E' 	

') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
marked AS (SELECT *, bare = '' OR nth > 1 AS goes, CAST(bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS INT) AS cut,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM seen),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (bare = '') AS blank,
    count(*) FILTER (bare <> '' AND nth > 1) AS duplicate, sum(cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
best AS ({_inserted(_START)} UNION ALL {_inserted(_NEXT)}),
chosen AS (SELECT conv_id, CAST(left(least(p0, p3), 12) AS BIGINT) AS cost, substr(least(p0, p3), 13) AS audit FROM best WHERE i = n),
edits AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS m
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS j FROM chosen WHERE audit <> '')),
left_over AS (SELECT e.conv_id, m, edit, CASE edit WHEN 'I' THEN '' ELSE text END AS text, CASE edit WHEN 'K' THEN role END AS role, max(CASE WHEN m = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS s
  FROM edits e LEFT JOIN marked r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i WHERE edit <> 'D'),
hashed AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY m)) AS h FROM left_over GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN chosen b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN hashed h ON a.conv_id IS NOT DISTINCT FROM h.conv_id
"""
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES = {"op12_conversation_repair": ORACLE}
