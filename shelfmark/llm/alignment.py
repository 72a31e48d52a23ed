"""Aligning the tokens of two tokenizers by a dictionary of groups.

A text's tokens by tokenizer A and by tokenizer B cover the same bytes; the offsets at which both end a
token cut them into groups, and each A token of a group is linked with each B token of it.  Nearly all
groups occur often, so links are made of distinct groups only:

1. ``grouped`` encodes each text once, and gives its groups - interned as ``a1,a2|b1`` - with their
   frequencies.  In the same pass a task counts, for pairs of ids that it saw linked, the documents that link them (a document is
   whole in one task, so none is counted twice); the expansion of a group into pairs is kept while its
   dictionary (at most ``DICTIONARY`` groups) lasts.
2. Counts of pairs are summed over tasks, and each A id gets its highest.
3. Distinct groups are expanded once; the pairs' counts, joined to them, are summed per group: links, links whose pair
   is the A id's best, and counts.
4. These come back to the documents by group: the ``HEAD`` most frequent groups as a broadcast table of bounded
   size, the others by a join; each is multiplied by its frequency.

Token bytes.  A: byte-level BPE from a file of ranks (bytes are what the ranks list).  B: a SentencePiece
model, U+2581 is a space and ``<0xHH>`` a byte.  A encodes a space and the text, B the text, to which it adds the space.

Hot groups and pairs are salted (``spread_join``).  Groups of any length stay whole; pairs of a group are made from its
distinct ids, not from its tokens, so repetitive texts whose tokens never end together stay small.

Defined cases: texts that are null, empty, or not covered by the tokens of both (B drops or changes something) have no tokens:
zeros and an empty string; repeated rows are documents of their own; a null identifier is kept; special
tokens' strings are plain text; texts of any length are encoded whole; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import portions, staged_in_small_batches
from shelfmark.llm.common import col, spread_join, staged
from shelfmark.llm.packing import byte_bpe_50k

#: Most groups that a task's dictionary holds, and pairs that it gathers, before it gives its counts.
DICTIONARY, GATHERED = 200_000, 4_000_000
#: Most groups in the broadcast table, and characters of a group that is in it.
HEAD, HEAD_CHARS = 100_000, 200
#: Bytes of text that are encoded at once.
TOGETHER = 1 << 19
#: Pairs are A id * SHIFT + B id.
SHIFT = 1 << 32


def piece_bpe_32k() -> str:
    """Path of the 32,000-piece SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def laid_out(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, places, all bytes) of a vocabulary's tokens."""
    sizes = np.array([len(x) for x in tokens], np.int64)
    return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8)


class ByteLevel:
    """Tokenizer A: a byte-level BPE whose special tokens are plain text."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = vocabulary
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.sizes, self.starts, self.flat = laid_out(self.bytes)

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.array(self.encoding.encode(text, allowed_special=set(), disallowed_special=()), np.int64)
        except ValueError:  # the pattern's stack overflowed on a run of white space
            return np.array(plain_encoder(self.vocabulary).encode(text, add_special_tokens=False).ids, np.int64)


@cache
def plain_encoder(vocabulary: str):
    """``tokenizers``' encoder of the JSON beside the ranks, special tokens being plain text."""
    from pathlib import Path

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(vocabulary).with_suffix(".json")))
    t.encode_special_tokens = True
    return t


class Pieces:
    """Tokenizer B: a SentencePiece model."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes = [self.token(i) for i in range(self.model.get_piece_size())]
        self.sizes, self.starts, self.flat = laid_out(self.bytes)

    def token(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


@cache
def tokenizers_of(vocabulary: str, model: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers; once per process."""
    return ByteLevel(vocabulary), Pieces(model)


def gathered(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated slices of a flat table."""
    ends = np.cumsum(sizes)
    return table[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


class Tokens:
    """The tokens of many texts by one tokenizer, one text after the other."""

    def __init__(self, tokenizer: ByteLevel | Pieces, ids: list[np.ndarray]):
        self.tokenizer, self.counts = tokenizer, np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        self.sizes = tokenizer.sizes[self.ids]
        self.text = np.repeat(np.arange(len(ids)), self.counts)

    def covers(self, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes are those of each text."""
        length = np.bincount(self.text, self.sizes, len(raw)).astype(np.int64)
        good = length == np.array([len(x) for x in raw], np.int64)
        keep = good[self.text]
        own = gathered(self.tokenizer.flat, self.tokenizer.starts[self.ids[keep]], self.sizes[keep])
        given = np.frombuffer(b"".join(x for x, ok in zip(raw, good.tolist(), strict=True) if ok), np.uint8)
        places = np.repeat(np.flatnonzero(good), length[good])
        good[places[own != given]] = False
        return good

    def only(self, good: np.ndarray) -> Tokens:
        """Without those of texts that aren't good."""
        keep = good[self.text]
        out = object.__new__(Tokens)
        out.tokenizer, out.counts = self.tokenizer, np.where(good, self.counts, 0)
        out.ids, out.sizes, out.text = self.ids[keep], self.sizes[keep], self.text[keep]
        return out


class Aligned:
    """Tokens and groups of many texts; texts that aren't covered by both tokenizers have none.

    ``code`` is each group's place in ``names``, the distinct groups of these texts.
    """

    def __init__(self, a: ByteLevel, b: Pieces, texts: list[str | None]):
        raw = [f" {t}".encode() if t else b"" for t in texts]
        nothing = np.zeros(0, np.int64)
        own_a = Tokens(a, [a.encode(f" {t}") if t else nothing for t in texts])
        own_b = Tokens(b, [b.encode(t) if t else nothing for t in texts])
        good = own_a.covers(raw) & own_b.covers(raw)
        self.a, self.b = own_a.only(good), own_b.only(good)
        ends_a, ends_b = np.cumsum(self.a.sizes), np.cumsum(self.b.sizes)
        ends = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, bool)
        ends[ends_b] = True
        last_a = np.flatnonzero(ends[ends_a])  # the last tokens of groups
        ends[ends_b] = False
        ends[ends_a] = True
        last_b = np.flatnonzero(ends[ends_b])
        self.first_a, self.first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
        self.size_a, self.size_b = (last - first[: len(last)] + 1 for last, first in ((last_a, self.first_a), (last_b, self.first_b)))
        self.text = self.a.text[last_a]
        self.name()

    def name(self) -> None:
        """Number the distinct groups; those of one shape are compared as rows of ids."""
        self.names: list[str] = []
        self.code = np.zeros(len(self.text), np.int64)
        shapes = self.size_a << 32 | self.size_b
        for shape in np.unique(shapes).tolist():
            n_a, n_b = shape >> 32, shape & (1 << 32) - 1
            at = np.flatnonzero(shapes == shape)
            rows = np.hstack([self.a.ids[self.first_a[at][:, None] + np.arange(n_a)], self.b.ids[self.first_b[at][:, None] + np.arange(n_b)]]).astype(np.int32)
            if n_a == n_b == 1:
                keys = rows[:, 0].astype(np.int64) << 32 | rows[:, 1]
            else:
                keys = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 4))).ravel()
            _, one, place = np.unique(keys, return_index=True, return_inverse=True)
            self.code[at] = place + len(self.names)
            self.names += [f"{','.join(map(str, r[:n_a]))}|{','.join(map(str, r[n_a:]))}" for r in rows[one].tolist()]

    def digests(self, n: int) -> list[str]:
        """SHA-256 of each text's groups in order."""
        named, ends = np.array(self.names, object)[self.code].tolist() if self.names else [], np.cumsum(np.bincount(self.text, minlength=n)).tolist()
        return [hashlib.sha256(";".join(named[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends)]


def ids_of(group: str) -> tuple[Counter, Counter]:
    """How often each A id and each B id is in a group."""
    a, b = group.split("|")
    return Counter(map(int, a.split(","))), Counter(map(int, b.split(",")))


def expanded(group: str) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, number of links of each) of a group."""
    a, b = ids_of(group)
    pairs = np.add.outer(np.fromiter(a, np.int64) * SHIFT, np.fromiter(b, np.int64)).ravel()
    return pairs, np.multiply.outer(np.fromiter(a.values(), np.int64), np.fromiter(b.values(), np.int64)).ravel()


#: A row of ``grouped`` is a document (rid), a part of a pair's count (pair), or of a group's (grp).
GROUPED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, rid bigint, groups array<string>, times array<bigint>, pair bigint, grp string, n bigint"
FIELDS = [
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("rid", pa.int64()),
    ("groups", pa.list_(pa.string())), ("times", pa.list_(pa.int64())), ("pair", pa.int64()), ("grp", pa.string()), ("n", pa.int64()),
]


class Counts:
    """A task's numbers of documents by pair and by group, and its dictionary of expansions."""

    def __init__(self):
        self.pairs: dict[str, np.ndarray] = {}
        self.documents: Counter[str] = Counter()
        self.gathered: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, names: list[str], text: np.ndarray, code: np.ndarray) -> None:
        """Count distinct (text, code); codes are places in ``names``."""
        if not names:
            return
        for g in names:
            if g not in self.pairs:
                self.pairs[g] = expanded(g)[0]
        self.documents.update(dict(zip(names, np.bincount(code, minlength=len(names)).tolist(), strict=True)))
        lists = [self.pairs[g] for g in names]
        sizes = np.array([len(x) for x in lists], np.int64)
        known, flat = np.unique(np.concatenate(lists), return_inverse=True)
        each = gathered(flat, (np.cumsum(sizes) - sizes)[code], sizes[code])
        own = np.unique(np.repeat(text, sizes[code]) << 32 | each) & (1 << 32) - 1  # a text counts a pair once
        self.gathered.append((known, np.bincount(own, minlength=len(known))))
        self.size += len(known)

    @property
    def full(self) -> bool:
        return len(self.pairs) > DICTIONARY or self.size > GATHERED

    def drain(self) -> Iterator[tuple[list, list, list]]:
        """(pairs, groups, numbers) in portions."""
        if self.gathered:
            pairs, place = np.unique(np.concatenate([p for p, _ in self.gathered]), return_inverse=True)
            n = np.bincount(place, np.concatenate([k for _, k in self.gathered])).astype(np.int64)
            for i in range(0, len(pairs), 100_000):
                yield pairs[i : i + 100_000].tolist(), [None] * len(pairs[i : i + 100_000]), n[i : i + 100_000].tolist()
            groups = list(self.documents.items())
            for i in range(0, len(groups), 100_000):
                own = groups[i : i + 100_000]
                yield [None] * len(own), [g for g, _ in own], [k for _, k in own]
        self.__init__()


def grouped(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their groups, and counts of pairs and groups: see GROUPED.  Stage the result."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers_of(vocabulary, model)
        counts, rid, id_type = Counts(), TaskContext.get().partitionId() << 33, None
        names = ["doc_id", *[n for n, _ in FIELDS]]

        def counted() -> Iterator[pa.RecordBatch]:
            for pairs, groups, n in counts.drain():
                given = {"pair": pairs, "grp": groups, "n": n}
                cols = [pa.array(given[name], t) if name in given else pa.nulls(len(n), t) for name, t in FIELDS]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), id_type), *cols], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for start, end, texts in portions(batch.column(1), TOGETHER):
                n, own = end - start, Aligned(a, b, texts)
                both, times = np.unique(own.text << 32 | own.code, return_counts=True)
                text, code = both >> 32, both & (1 << 32) - 1
                counts.add(own.names, text, code)
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=n))).astype(np.int32))
                links = np.bincount(own.text, own.size_a * own.size_b, n).astype(np.int64)
                cols = [
                    pa.array(own.a.counts), pa.array(own.b.counts), pa.array(np.bincount(own.text, minlength=n)), pa.array(links), pa.array(own.digests(n), pa.string()),
                    pa.array(np.arange(rid, rid + n)), pa.ListArray.from_arrays(offsets, pa.array(own.names, pa.string()).take(pa.array(code))), pa.ListArray.from_arrays(offsets, pa.array(times)),
                    *[pa.nulls(n, t) for _, t in FIELDS[8:]],
                ]
                rid += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), *cols], names=names)
                if counts.full:
                    yield from counted()
        if id_type is not None:
            yield from counted()

    return rows.mapInArrow(run, f"doc_id {kind}, {GROUPED}")


def expansions(groups: DataFrame) -> DataFrame:
    """(grp, pair, links) of distinct groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for i in range(0, len(rows), 1000):
                own = rows[i : i + 1000]
                made = [expanded(g) for g in own]
                if made:
                    names = pa.array(own, pa.string()).take(pa.array(np.repeat(np.arange(len(own)), [len(p) for p, _ in made])))
                    pairs, links = (np.concatenate([m[k] for m in made]) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([names, pa.array(pairs), pa.array(links)], names=["grp", "pair", "links"])

    return groups.select("grp").mapInArrow(run, "grp string, pair bigint, links bigint")


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that link a pair, and whether no pair of its A id has more."""
    pairs = staged(made.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {SHIFT}")), "pairs")
    tops = pairs.groupBy("a").agg(F.max("n").alias("top"))  # a row per id of the vocabulary
    return pairs.join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def group_values(made: DataFrame) -> DataFrame:
    """Staged (grp, documents, n_best, count_sum) of distinct groups."""
    groups = staged(made.where("grp IS NOT NULL").groupBy("grp").agg(F.sum("n").alias("documents")), "groups")
    links = staged_in_small_batches(expansions(groups), "links")
    sizes = links.groupBy("pair").agg(F.count(F.lit(1)).alias("size"))
    known = staged(pair_counts(made).join(sizes, "pair"), "known")
    met = spread_join(links, known, "pair", "size")
    values = met.groupBy("grp").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    return staged(values.join(groups, "grp"), "values")


def valued(documents: DataFrame, values: DataFrame) -> DataFrame:
    """(rid, n_best, count_sum) of documents, in parts that are to be summed."""
    short = values.where(F.length("grp") <= HEAD_CHARS)
    head = short.orderBy(F.desc("documents"), "grp").limit(HEAD).select("grp", "n_best", "count_sum").toArrow()  # at most HEAD rows
    keys, best, total = (head.column(i).combine_chunks() for i in range(3))
    shared = documents.sparkSession.sparkContext.broadcast((keys, best.to_numpy(zero_copy_only=False), total.to_numpy(zero_copy_only=False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_best, count_sum = shared.value
        for batch in batches:
            rid, groups, times = batch.columns
            of, each, n = pc.list_parent_indices(groups).to_numpy(), pc.list_flatten(groups), pc.list_flatten(times).to_numpy()
            at = pc.fill_null(pc.index_in(each, known), -1).to_numpy()
            hit = at >= 0
            sums = [np.bincount(of[hit], minlength=len(rid)), np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64)]
            np.add.at(sums[1], of[hit], n_best[at[hit]] * n[hit])
            np.add.at(sums[2], of[hit], count_sum[at[hit]] * n[hit])
            rest = pa.array(np.flatnonzero(~hit))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([rid, rid.take(pa.array(of[~hit]))]), pa.concat_arrays([pa.nulls(len(rid), pa.string()), each.take(rest)]), pa.concat_arrays([pa.nulls(len(rid), pa.int64()), pa.array(n[~hit], pa.int64())]),
                 *[pa.concat_arrays([pa.array(s, pa.int64()), pa.nulls(len(rest), pa.int64())]) for s in sums[1:]]],
                names=["rid", "grp", "times", "n_best", "count_sum"],
            )

    made = staged_in_small_batches(documents.select("rid", "groups", "times").mapInArrow(run, "rid bigint, grp string, times bigint, n_best bigint, count_sum bigint"), "valued")
    rest = made.where("grp IS NOT NULL").select("rid", "grp", "times")
    met = spread_join(rest, values, "grp", "documents").select("rid", (F.col("n_best") * F.col("times")).alias("n_best"), (F.col("count_sum") * F.col("times")).alias("count_sum"))
    return made.where("grp IS NULL").select("rid", "n_best", "count_sum").unionByName(met)


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = staged_in_small_batches(grouped(docs, vocabulary or byte_bpe_50k(), model or piece_bpe_32k(), id_col, text_col), "grouped")
    documents = made.where("rid IS NOT NULL")
    sums = valued(documents, group_values(made))
    own = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    whole = documents.select("rid", F.struct(*own).alias("own"), F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"))
    parts = sums.select("rid", F.lit(None).cast(whole.schema["own"].dataType).alias("own"), "n_best", "count_sum")
    met = whole.unionByName(parts).groupBy("rid").agg(F.max("own").alias("own"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return met.select("own.doc_id", "own.n_a", "own.n_b", "own.n_groups", "own.n_links", "n_best", "count_sum", "own.groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {}
