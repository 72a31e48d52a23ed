"""Near-duplicate detection: ProbMinHash signatures, banding, exact verification, components.

A text's words (lower case, runs of letters, digits and underscores) give weighted shingles:
each run of five words (a shorter text: all its words) with its number of occurrences.
ProbMinHash lets every shingle arrive at random registers as a Poisson process whose rate is its
weight; a register keeps the shingle that arrives first, and a shingle stops as soon as its next
arrival is later than all registers.  Two registers agree with the probability Jaccard
similarity.  Bands of five registers propose candidates - a pair at 0.8 is missed with a
probability below 1e-4 - and pairs are verified with the exact similarity of the whole texts.

Texts with the same words are one vertex.  Buckets connect vertices to groups.  A group of bounded
size is verified in one task; the members of a larger one are dealt over blocks, and each pair of
blocks meets in one task.  There the mass that each pair has in common is summed up for all pairs at
once; it bounds their similarity from above (and is it for shingles that occur once), so only pairs
that can be near are verified one by one, unless they are in one component already.  A group of n
copies of one page that differ too much from each other has n * n candidates and hardly a link: these
cost a few multiplications each, and no row of their own.  The classes are those of testing all
candidate pairs.

Defined cases: a null text is empty; texts without words are near-duplicates only if identical;
a null identifier is smaller than any other; repeated rows are copies; a class's representative
is the row with the smallest identifier (then address).  Other columns are free, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import portions, staged_in_small_batches
from shelfmark.llm.common import col, located, members_bitmap, spread_join, staged, with_maybe, without
from shelfmark.llm.suffix_array import ragged

WORD = re.compile(r"\w+")
SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
CACHE = 100_000
#: Texts are hashed together up to this many bytes, which bounds the memory of a worker.
TOGETHER = 1_000_000
#: Groups of candidates up to this size are verified within one task; larger ones by pairs of blocks
#: of half of it.
GROUP_ROWS = 4096
GROUP_WORDS = 8_000_000
#: Members whose candidates are bounded together, shingles of a matrix, and pairs of rarer ones at once.
TILE, WIDE, EXPANDED = 256, 512, 500_000

U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)  # odd; 2**64 divided by the golden ratio


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (constants: any odd numbers do)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Shingler:
    """Weighted shingles of many texts at once; word hashes are cached within bounds."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, texts: list[str | None]) -> list[list[str]]:
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        missing = {w for words in found for w in words if w not in self.known}
        if len(self.known) + len(missing) > CACHE:
            self.known, missing = {}, {w for words in found for w in words}
        self.known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in missing)
        return found

    def shingles(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, weight) of each distinct shingle of each text, by text and hash."""
        lengths = np.array([len(w) for w in found], np.int64)
        known = self.known
        flat = np.fromiter((known[w] for words in found for w in words), U, int(lengths.sum()))
        of = np.repeat(np.arange(len(found)), lengths)
        starts = np.cumsum(lengths) - lengths
        rank = np.arange(len(flat)) - starts[of]
        value, width = flat.copy(), np.minimum(lengths, SHINGLE)[of]
        for k in range(1, SHINGLE):
            following = np.zeros_like(flat)
            following[: max(0, len(flat) - k)] = flat[k:]
            value = np.where(k < width, mix64(value * MULTIPLIER + following), value)
        whole = rank <= lengths[of] - width  # a shingle starts here
        of, value = of[whole], value[whole]
        order = np.lexsort((value, of))
        of, value = of[order], value[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        at = np.flatnonzero(new)
        return of[at], value[at], np.diff(np.append(at, len(of)))


def prob_minhash(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (texts x m): in each register the shingle that arrives there first.

    All shingles of all texts advance together, one arrival per round; those whose next arrival
    comes after every register of their text was filled earlier are done.
    """
    first = np.full(texts * m, np.inf)
    kept = np.zeros(texts * m, U)
    state = mix64(shingle ^ MULTIPLIER)
    time = np.zeros(len(shingle))
    active = np.arange(len(shingle))
    while len(active):
        state = mix64(state + MULTIPLIER)
        uniform = ((state >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time = time - np.log(uniform) / weight[active]
        register = of[active] * m + (mix64(state ^ U(0xA5A5A5A5A5A5A5A5)) % U(m)).astype(np.int64)
        earlier = np.flatnonzero(time < first[register])
        # the earliest arrival of a register is written last; ties go to the smaller shingle
        order = earlier[np.lexsort((~shingle[active[earlier]], -time[earlier]))]
        first[register[order]] = time[order]
        kept[register[order]] = shingle[active[order]]
        latest = first.reshape(texts, m).max(axis=1)
        going = time < latest[of[active]]
        active, state, time = active[going], state[going], time[going]
    return kept.reshape(texts, m)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys (texts x BANDS) of 64 bits; a band's number is part of its key."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=U)), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * MULTIPLIER + parts[:, :, k])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i), for (hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][at] == a[0])
    if not len(i):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][at[i]].astype(np.float64)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = np.cumsum(x[::-1])[::-1]  # of those with a ratio x / y not below this one's
    below = np.cumsum(y) - y
    return float((1.0 / ((above + only_x) / x + (below + only_y) / y)).sum())


SIGNED = "id {kind}, file string, row bigint, h1 bigint, h2 bigint, words bigint, bands array<bigint>"


def signed(placed: DataFrame) -> DataFrame:
    """One row per text: id, address, digest of its words (two numbers), band keys (if it has words)."""
    rows = placed.select("id", "file", "row", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for a, b, part in portions(batch.column(3), TOGETHER):
                found = shingler.words(part)
                of, value, weight = shingler.shingles(found)
                keys = band_keys(prob_minhash(of, value, weight, len(part)))
                digests = [
                    xxhash.xxh3_128_digest((" ".join(w) if w else "\0" + (t or "")).encode("utf-8", "surrogatepass"))
                    for w, t in zip(found, part, strict=True)
                ]
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                own = batch.slice(a, b - a)
                bands = pa.array([k if w else [] for k, w in zip(keys.tolist(), found, strict=True)], pa.list_(pa.int64()))
                cols = [own.column(0), own.column(1), own.column(2), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                        pa.array([len(w) for w in found], pa.int64()), bands]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "file", "row", "h1", "h2", "words", "bands"])

    return rows.mapInArrow(run, SIGNED.format(kind=kind))


def weighted(placed: DataFrame, vertices: DataFrame) -> DataFrame:
    """Shingles of the representatives (v, g, blocks, bands, file, row) of vertices: v, g, blocks,
    bands, hashes, weights (binary).

    Other rows are dropped where they are read, by a bitmap of the addresses.
    """
    rows = placed.select("file", "row", "text")
    some = with_maybe(rows, members_bitmap(vertices, "file", "row"), "file", "row").where("__maybe").drop("__maybe")
    met = some.join(vertices, ["file", "row"]).select("v", "g", "blocks", "bands", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for first, end, part in portions(batch.column(4), TOGETHER):
                of, value, weight = shingler.shingles(shingler.words(part))
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                hashes = [value[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                weights = [weight[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                own = batch.slice(first, end - first)
                cols = [*[own.column(k) for k in range(4)], pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["v", "g", "blocks", "bands", "hashes", "weights"])

    return met.mapInArrow(run, "v bigint, g bigint, blocks int, bands array<bigint>, hashes binary, weights binary")


def in_common(sets: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, x, y) by tiles of rows: x[i, j] is the share of row i's weight on shingles that
    member j has too, y[i, j] that of j's on those of row i.

    Shingles that many members have are columns of matrices; the others' pairs are listed.
    """
    n = len(sets)
    sizes = np.array([len(hashes) for hashes, _ in sets], np.int64)
    of = np.repeat(np.arange(n), sizes)
    mass = np.concatenate([w / max(int(w.sum(dtype=np.int64)), 1) for _, w in sets])
    _, shingle, counts = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    order = np.argsort(shingle, kind="stable")  # by shingle, then by member
    of, mass, starts = of[order], mass[order], np.cumsum(counts) - counts
    many = np.flatnonzero(counts >= max(16, n // 10))
    few = np.flatnonzero((counts > 1) & (counts < max(16, n // 10)))
    at, which = ragged(starts[few], counts[few])
    which = few[which]
    for a in range(0, n, TILE):
        b = min(a + TILE, n)
        x, y = np.zeros((b - a, n), np.float32), np.zeros((b - a, n), np.float32)
        for k in range(0, len(many), WIDE):
            some, column = ragged(starts[many[k : k + WIDE]], counts[many[k : k + WIDE]])
            weight = np.zeros((n, min(WIDE, len(many) - k)), np.float32)
            weight[of[some], column] = mass[some]
            there = (weight > 0).astype(np.float32)
            x += weight[a:b] @ there.T
            y += there[a:b] @ weight.T
        own = (of[at] >= a) & (of[at] < b)
        rows, kinds = at[own], which[own]
        ends = np.cumsum(counts[kinds])
        first = 0
        while first < len(rows):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + EXPANDED, side="right")))
            others, row = ragged(starts[kinds[first:last]], counts[kinds[first:last]])
            row = rows[first:last][row]
            key = (of[row] - a) * n + of[others]
            x += np.bincount(key, mass[row], (b - a) * n).reshape(b - a, n).astype(np.float32)
            y += np.bincount(key, mass[others], (b - a) * n).reshape(b - a, n).astype(np.float32)
            first = last
        yield a, x, y


def components(keys: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Component of each member of a group (index of one of its members).

    Pairs that share a band key are verified unless they are in one component already, or what they
    have in common rules them out: with x of one's weight and y of the other's there, the similarity
    is x * y / (x + y - x * y) at most (the sum over common shingles of 1 / (1 / x_i + (1 - y) / y_i)
    bounds it, and that is concave).
    """
    parent = np.arange(len(sets))
    for first, x, y in in_common(sets):
        both = x * y
        possible = both >= (threshold - 1e-3) * (x + y - both)  # more than float32 loses
        for k, row in enumerate(possible):
            i = first + k
            near = np.flatnonzero(row[i + 1 :] & (parent[i + 1 :] != parent[i])) + i + 1
            near = near[(keys[near] == keys[i]).any(axis=1)]
            for j in near:
                if parent[j] != parent[i] and probability_jaccard(sets[i], sets[j]) >= threshold:
                    parent[parent == parent[j]] = parent[i]
    return parent


def clustered(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(v, g, cell, split, bands, hashes, weights), sorted by g and cell -> (v, split, c) for each cell."""
    current, part = None, []

    def close() -> pa.RecordBatch:
        keys = np.array([p[1] for p in part], np.int64)
        sets = [(np.frombuffer(p[2], "<u8"), np.frombuffer(p[3], "<u4")) for p in part]
        v = np.array([p[0] for p in part], np.int64)
        cols = [pa.array(v), pa.array(np.full(len(v), current[2])), pa.array(v[components(keys, sets, threshold)])]
        return pa.RecordBatch.from_arrays(cols, names=["v", "split", "c"])

    for batch in batches:
        bands = batch.column(4)
        for k, (v, *cell) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True)):
            if cell != current:
                if part:
                    yield close()
                current, part = cell, []
            part.append((v, bands[k].values.to_numpy(), batch.column(5)[k].as_py(), batch.column(6)[k].as_py()))
    if part:
        yield close()


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (v, c) after merging the components that links (a, b) connect; staged.

    Each round hooks every label to its smallest neighbour, follows the hooks twice, and
    relabels; links within a component drop out, and the rounds end when none is left.
    """
    edges = links.select("a", "b")
    first = True
    while True:
        if first:  # from vertices to labels
            edges = edges.join(labels.select(F.col("v").alias("a"), F.col("c").alias("x")), "a").join(
                labels.select(F.col("v").alias("b"), F.col("c").alias("y")), "b")
            first = False
        edges = staged(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        hooks = staged(edges.groupBy(F.col("y").alias("from")).agg(F.min("x").alias("to")), "hooks")
        for _ in range(2):
            up = hooks.select(F.col("from").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(up, "to", "left").select("from", F.coalesce("further", "to").alias("to"))
        hooks = staged(hooks, "hooks")
        sizes = labels.groupBy("c").agg(F.count(F.lit(1)).alias("n"))  # a component may hold most vertices
        moved = staged(hooks.select(F.col("from").alias("c"), "to").join(sizes, "c"), "moved")
        labels = staged(spread_join(labels, moved, "c", "n").select("v", F.coalesce("to", "c").alias("c")), "labels")
        edges = edges.join(hooks.select(F.col("from").alias("x"), F.col("to").alias("nx")), "x", "left").select(
            F.coalesce("nx", "x").alias("x"), "y")
        edges = edges.join(hooks.select(F.col("from").alias("y"), F.col("to").alias("ny")), "y", "left").select(
            "x", F.coalesce("ny", "y").alias("y"))


def cells() -> Column:
    """The pairs of blocks in which a vertex ``v`` of a group of ``blocks`` blocks meets others."""
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("long")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda k: k != own)
    met = F.transform(others, lambda k: F.least(own, k) * F.col("blocks") + F.greatest(own, k))
    return F.when(F.col("blocks") > 1, met).otherwise(F.array(F.lit(0).cast("long")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
               group_rows: int = GROUP_ROWS, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, file, row, class_id (identifier of the class's
    representative), class_size, copies (rows with the same words), representative."""
    return classes_of(placed_texts(docs, id_col, text_col), threshold, group_rows, group_words)


def placed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return located(docs, id=col(id_col), text=col(text_col).cast("string"))


def classes_of(placed: DataFrame, threshold: float, group_rows: int = GROUP_ROWS, group_words: int = GROUP_WORDS) -> DataFrame:
    """``near_dedup`` of located rows (id, text, file, row)."""
    spark = placed.sparkSession
    rows = staged_in_small_batches(signed(placed), "signed")
    vertices = rows.groupBy("h1", "h2").agg(
        F.min(F.struct("id", "file", "row")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("words").alias("words"),
        F.first("bands").alias("bands"),
    )
    vertices = staged(vertices.withColumn("v", F.monotonically_increasing_id()), "vertices")
    banded = vertices.select("v", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("p")).where("n > 1")
    buckets = staged(buckets, "buckets")
    members = with_maybe(banded, members_bitmap(buckets, "key"), "key").where("__maybe").drop("__maybe")
    members = staged(spread_join(members, buckets, "key", "n", "inner").select("key", "v", "n", "p"), "members")
    involved = staged(members.select("v").distinct().withColumn("c", F.col("v")), "involved")
    # groups: what buckets connect, directly or not
    groups = merge_components(involved, members.where("v <> p").select(F.col("v").alias("a"), F.col("p").alias("b")).distinct())
    where = vertices.join(groups, "v").select("v", F.col("c").alias("g"), "bands", "words", "rep.file", "rep.row")
    sizes = where.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    fill = F.greatest(F.ceil(F.lit(2.0) * F.col("n") / group_rows), F.ceil(F.lit(2.0) * F.col("words") / group_words))
    large = sizes.where((F.col("n") > group_rows) | (F.col("words") > group_words)).where("n > 1")
    large = staged(large.select("g", "n", F.least("n", F.greatest(fill, F.lit(2))).cast("int").alias("blocks")), "large")
    few = where.drop("words").join(large, "g", "left_anti").withColumn("blocks", F.lit(1))
    sets, some = weighted(placed, staged(few, "small")), not large.isEmpty()
    if some:
        rest = staged(spread_join(where.drop("words"), large, "g", "n", "inner").drop("n"), "rest")
        sets = sets.unionByName(weighted(placed, rest))
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets = sets.select("v", "g", F.explode(cells()).alias("cell"), (F.col("blocks") > 1).alias("split"), "bands", "hashes", "weights")
    sets = sets.repartition(parts, "g", "cell").sortWithinPartitions("g", "cell", "v")
    labels = staged_in_small_batches(sets.mapInArrow(lambda it: clustered(it, threshold), "v bigint, split boolean, c bigint"), "labels")
    if some:  # the components of blocks that met
        linked = labels.where("split AND v <> c").select(F.col("v").alias("a"), F.col("c").alias("b"))
        begin = staged(rest.select("v", F.col("v").alias("c")), "labels")
        labels = labels.where("NOT split").select("v", "c").unionByName(merge_components(begin, linked))
    classed = staged(vertices.join(labels, "v", "left").select("h1", "h2", "rep", "copies", F.coalesce("c", "v").alias("c")), "labelled")
    best = classed.groupBy("c").agg(F.min("rep").alias("best"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n"))
    met = spread_join(classed, staged(best, "classes"), "c", "n", "inner")
    of = staged(met.select(F.struct("h1", "h2").alias("key"), "copies", "best", "class_size"), "classed")
    out = spread_join(rows.select("id", "file", "row", F.struct("h1", "h2").alias("key")), of, "key", "copies")
    return out.select(
        "id", "file", "row", F.col("best.id").alias("class_id"), "class_size", "copies",
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("representative"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that represent their class, with its columns."""
    base = placed_texts(docs, id_col, text_col)
    gone = classes_of(base, threshold).where("not representative").select("file", "row")
    return without(base, staged(gone, "dropped"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_dedup(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size", "copies", F.col("representative").alias("kept"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES: dict[str, str] = {}
