"""Best-fit packing of token sequences by length histogram.

Texts are tokenised and only those longer than the capacity are cut (into pieces of the
capacity; the first piece may be shorter).  The plan is made from the histogram of piece
lengths - at most ``capacity`` numbers, whatever the size of the data: best-fit decreasing over
counts.  Sequences with equal room form groups of consecutive numbers; a length's pieces go to
the groups with the least room that suffices, as many to each sequence as fit, exactly as best
fit would place them one by one.  The plan says which ranks of a length go where; pieces then
take their slots by rank within their length.

Ranks need no sort: a task numbers the pieces of each length as it writes them, and the
numbers of earlier tasks are summed per length.

Tokenisation: the ids are those of the byte-level BPE whose ranks are in ``vocabulary`` (see
``byte_bpe_50k``); ``tiktoken`` computes them, which the tests compare with ``tokenizers``.  The
vocabulary's added tokens (``<|endoftext|>``) are matched inside texts, as ``tokenizers`` does.
``tiktoken``'s pattern engine gives up on runs of about a million white-space characters; texts
with such runs are encoded by ``tokenizers`` itself.

Defined cases: a null text is empty; an empty text is one piece that holds the end id only;
every row gives its pieces, repeated ones too; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.batches import staged_in_small_batches
from shelfmark.llm.common import col

CAPACITY = 2048
END_ID = 0
#: A plan of up to this many ranges is broadcast; a longer one is joined by a shuffle.
BROADCAST_RANGES = 200_000


def byte_bpe_50k() -> str:
    """Path of the vocabulary (ranks) of the 50,257-entry byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Ids of the added tokens by content, from the JSON beside the ranks; none without it."""
    path = Path(vocabulary).with_suffix(".json")
    if not path.exists():
        return {}
    return {t["content"]: t["id"] for t in json.loads(path.read_text("utf-8"))["added_tokens"]}


@cache
def encoder(vocabulary: str):
    """The encoder of a vocabulary file; one per process."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(vocabulary))


@cache
def slow_encoder(vocabulary: str):
    """``tokenizers``' encoder of the JSON beside a vocabulary file; one per process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(Path(vocabulary).with_suffix(".json")))


def encode(vocabulary: str, text: str) -> list[int]:
    """The ids of a text; an added token in it has its own id."""
    try:
        return encoder(vocabulary).encode(text, allowed_special="all", disallowed_special=())
    except ValueError:  # the pattern's stack overflowed on a run of white space
        return slow_encoder(vocabulary).encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a document of n ids; only the first may be shorter."""
    at = min(n, n % capacity or capacity)
    yield 0, at
    while at < n:
        yield at, at + capacity
        at += capacity


PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, task int, place bigint"
#: Rows leave a task in batches of about this many ids.
BATCH_IDS = 1 << 20


def tokenised(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
              with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, ids (or null), and their place among the
    task's pieces of their length.  Stage the result before its places are used."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "place"]
        for batch in batches:
            cols, size = [[] for _ in names], 0

            def flush(batch=batch):
                data = [pa.array(cols[0], batch.column(0).type), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]]
                return pa.RecordBatch.from_arrays(data, names=names)

            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(vocabulary, text.as_py() or ""), END_ID], "<u4")
                for k, (a, b) in enumerate(cut(len(ids), capacity)):
                    raw = ids[a:b].tobytes()
                    row = (doc_id.as_py(), k, a, b - a, zlib.crc32(raw), raw if with_ids else None, task, seen[b - a])
                    seen[b - a] += 1
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                size += len(ids)
                if size >= BATCH_IDS:
                    yield flush()
                    cols, size = [[] for _ in names], 0
            if cols[0]:
                yield flush()

    return rows.mapInArrow(run, f"doc_id {kind}, {PIECE}")


@dataclass(frozen=True)
class Range:
    """Ranks [first, last) of a length: ``per`` of them to each sequence from ``sequence`` on."""

    length: int
    first: int
    last: int
    sequence: int
    per: int
    offset: int


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Range]:
    """Best-fit decreasing over counts.  Sequences are numbered from 0."""
    rooms: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number of sequences)
    out: list[Range] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            own = groups[room]
            if own and own[-1][0] + own[-1][1] == first:
                own[-1] = (own[-1][0], own[-1][1] + n)
            else:
                own.append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = room // length
            full = min(n, left // per)
            part = left - full * per if full < n else 0  # what one more sequence gets
            for count, each, at in ((full, per, first), (1, part, first + full)):
                if count and each:
                    out.append(Range(length, rank, rank + count * each, at, each, capacity - room))
                    rank += count * each
                    put(room - each * length, at, count)
            used = full + bool(part)
            put(room, first + used, n - used)
            left -= full * per + part
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """Staged pieces with ``rank``, counted from 0 within their length."""
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return pieces.join(counts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "task", "place")


RANGE = "length bigint, first bigint, last bigint, sequence bigint, per bigint, at bigint"


def place(pieces: DataFrame, plan: list[Range]) -> DataFrame:
    """Ranked pieces with their ``sequence_id`` and ``offset``."""
    spark: SparkSession = pieces.sparkSession
    table = spark.createDataFrame([(r.length, r.first, r.last, r.sequence, r.per, r.offset) for r in plan], RANGE)
    side = F.broadcast(table) if len(plan) <= BROADCAST_RANGES else table
    slot = F.col("rank") - F.col("first")
    met = pieces.join(side, "length").where("rank >= first AND rank < last")
    return met.withColumn("sequence_id", F.col("sequence") + F.expr("(rank - first) div per")).withColumn(
        "offset", F.col("at") + (slot % F.col("per")) * F.col("length")
    ).drop("first", "last", "sequence", "per", "at", "rank")


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = staged_in_small_batches(tokenised(docs, vocabulary or byte_bpe_50k(), id_col, text_col, capacity, with_ids), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    plan = plan_best_fit({r["length"]: r["n"] for r in counts}, capacity)
    out = place(ranked(pieces), plan)
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
