"""Toxicity scores from a weighted lexicon.

Folding.  Texts are brought to a plain form before anything is matched: compatibility forms and
case, invisible characters, homoglyphs (Cyrillic and Greek letters that look like Latin ones),
and digits or symbols that stand for letters inside words (``1d10t``); whatever is no letter then
is one space.  Digits that touch no letter, and symbols that no letter follows, aren't folded.

Lexicon.  An entry is the beginning of a word, or a whole word, with a weight: its log odds in
toxic against clean texts.  Exception phrases (of one or more whole words) cancel the entries that
lie within them.  Both are found by one Aho-Corasick automaton over the folded text; a word counts with
the largest weight of its entries.  The score is a logistic function of the sum of the weights and of
that sum by the text's number of words.

Learning (``train``) takes at most ``per_label`` labelled texts of each label, those with the smallest
hashes of their identifiers.  Of texts with one identifier that with the smallest hash counts, and
of near copies (equal smallest hash of five words) one.  Words as frequent in clean texts
as in toxic ones are exceptions; beginnings of the other words that toxic texts have at least
``FACTOR`` times as often as clean ones are entries.  The logistic function is fitted on the half of
the sample that the lexicon wasn't learned from (on the whole sample, if a half has under ``HALF`` texts of
a label), and its intercept is corrected to the labels' shares among all labelled documents.

Defined cases: a null text is empty and scores as a text without entries; a null or repeated identifier is
scored like any other; labels that are null or neither 0 nor 1 are not learned from, of contradicting
labels of one identifier the larger counts; without a label of either kind every score is the share of toxic
labels (0 without any); equal texts have equal scores; texts of any length are matched whole; an
empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import portions, staged_in_small_batches
from shelfmark.llm.common import col

#: Most labelled texts of each label that are learned from.
PER_LABEL = 4000
#: A half of the sample with fewer texts of a label is too small to learn from alone.
HALF = 20
#: Entries have at least this many letters, or are whole words.
SHORTEST, LONGEST = 4, 12
#: Toxic texts (in numbers of words and texts) that an entry needs, and how much more frequent it is there.
LEAST, FACTOR = 3, 8.0
#: Clean texts that make a word an exception, unless toxic texts have it more often.
USUAL = 2
#: A text is toxic from this score on.
THRESHOLD = 0.7

# Letters that look like Latin ones (Cyrillic, Greek), and what digits and symbols stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ɑ": "a",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"

TABLE = str.maketrans(LOOKALIKES | SUBSTITUTES | dict.fromkeys(INVISIBLE, ""))
PLAIN = str.maketrans(SUBSTITUTES)
#: Digits that touch no letter and symbols that no letter or digit follows: neither stands for a letter.
STANDING = re.compile(r"(?<![^\W\d_])[0-9]+(?![^\W\d_@$!|])|[@$!|]+(?![^\W_@$!|])")
GAPS = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The words of a text in plain form, each with a space on both sides."""
    if text.isascii():
        text = STANDING.sub(" ", text.lower()).translate(PLAIN)
    else:
        text = unicodedata.normalize("NFKC", text).casefold()
        text = STANDING.sub(" ", text).translate(TABLE)
    return f" {GAPS.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Entries (`` begin`` or `` word ``) with weights, exception phrases, and the logistic function."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    bias: float = -np.inf
    total: float = 0.0
    rate: float = 0.0


class Matcher:
    """The automaton of a lexicon; one per task."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        found: dict[str, list] = {}
        for entry, weight in lexicon.entries.items():
            found.setdefault(entry, [None, False])[0] = weight
        for phrase in lexicon.exceptions:
            found.setdefault(f" {phrase.strip()} ", [None, False])[1] = True
        for key, (weight, exempt) in found.items():
            self.automaton.add_word(key, (len(key), weight, exempt))
        if found:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """The weight of each word (by its place) that has an entry outside exceptions."""
        if not len(self.automaton):
            return {}
        best: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, (n, weight, is_exempt) in self.automaton.iter(folded):
            start = end - n + 1
            if is_exempt:
                exempt.append((start, end))
            if weight is not None and weight > best.get(start, 0.0):
                best[start] = weight
        if exempt and best:
            starts, reach = [], []  # exceptions by start, and how far those so far reach
            for a, b in sorted(exempt):
                starts.append(a)
                reach.append(max(b, reach[-1]) if reach else b)
            at = np.array(list(best))
            k = np.searchsorted(starts, at, side="right") - 1
            inside = (k >= 0) & (np.array(reach)[k] > at)
            best = {a: best[a] for a in at[~inside].tolist()}
        return best

    def features(self, text: str | None) -> tuple[float, float, int]:
        """(sum of weights, the same by number of words, number of words with an entry)."""
        folded = fold(text or "")
        own = self.hits(folded)
        total = sum(sorted(own.values()))
        return total, total / max(1, folded.count(" ") - 1), len(own)

    def score(self, total: float, rate: float) -> float:
        x = self.lexicon
        z = x.bias + x.total * np.log1p(total) + x.rate * np.log1p(100.0 * rate)
        with np.errstate(over="ignore"):
            return float(1.0 / (1.0 + np.exp(-z)))


def crc_is(id_col: str, folds: int, value: int) -> Column:
    """Whether crc32 of an identifier as text leaves this remainder; not so for null."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % folds == value, F.lit(False))


def sketch(folded: str) -> int:
    """The smallest hash of five words in a row: near copies mostly share it, other texts don't."""
    words = folded.encode().split()
    return min((zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """Staged (label, part, folded) of at most ``per_label`` texts of each label, and the numbers of all."""
    label = col(label_col).cast("int")
    known = labels.select(col(id_col).alias("doc_id"), label.alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    ids = [known.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for x in (0, 1)]
    texts = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")  # at most 2 * per_label rows
    one = met.groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.xxhash64("text")).alias("x")).select("x.*")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in portions(batch.column(1), 1 << 20):
                folded = [fold(t) for t in own]
                keys = [sketch(t) for t in folded]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.int64()), pa.array(folded, pa.string())], names=["label", "key", "folded"])

    made = one.mapInArrow(run, "label int, key bigint, folded string")
    alone = made.groupBy("key").agg(F.max_by(F.struct("label", "folded"), F.struct("label", "folded")).alias("x")).select("x.*", (F.col("key") % 2).cast("int").alias("part"))
    return staged_in_small_batches(alone, "labelled"), sizes


def counted_words(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): how many texts of each label have a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in portions(batch.column(1), 1 << 20):
                counts: dict[str, list[int]] = {}
                for label, text in zip(batch.column(0).slice(a, b - a).to_pylist(), texts, strict=True):
                    for w in set(text.split()):
                        counts.setdefault(w, [0, 0])[label] += 1
                clean, toxic = zip(*counts.values(), strict=True) if counts else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["word", "toxic", "clean"])

    return sample.select("label", "folded").mapInArrow(run, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learned(sample: DataFrame) -> Lexicon:
    """Entries and exceptions from staged labelled texts."""
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = staged_in_small_batches(counted_words(sample), "words")

    def odds(toxic: str, clean: str) -> Column:
        return F.log((F.col(toxic) + 0.5) / F.lit(n.get(1, 0) + 1.0)) - F.log((F.col(clean) + 0.5) / F.lit(n.get(0, 0) + 1.0))

    usual = (F.col("clean") >= USUAL) & (odds("toxic", "clean") < np.log(2.0))
    marked = words.withColumn("usual", usual)
    begins = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda k: F.concat(F.lit(" "), F.substring("word", F.lit(1), k)))
    whole = F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    keys = F.when(F.length("word") >= SHORTEST, F.concat(begins, whole)).otherwise(whole)
    counts = marked.where("not usual").select(F.explode(keys).alias("entry"), "toxic", "clean").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    chosen = counts.where(F.col("toxic") >= LEAST).withColumn("weight", odds("toxic", "clean")).where(F.col("weight") >= float(np.log(FACTOR)))
    entries = {r["entry"]: r["weight"] for r in chosen.select("entry", "weight").toLocalIterator()}  # bounded by the sample
    own = {e: w for e, w in entries.items() if all(w > entries.get(e[:k], -1.0) for k in range(SHORTEST + 1, len(e)))}
    near = marked.where("usual").select("word", F.explode(keys).alias("entry"))
    spark = sample.sparkSession
    heads = spark.createDataFrame([(e,) for e in own], "entry string")
    return Lexicon(own, {r["word"] for r in near.join(heads, "entry", "left_semi").select("word").distinct().toLocalIterator()})


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; every column but the first is shrunk."""
    a = np.column_stack([np.ones(len(x)), x])
    keep, w = np.diag([1e-6, *[ridge] * x.shape[1]]), np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Lexicon:
    """The lexicon of texts that ``labels`` marks with 1, against those with 0."""
    sample, sizes = sampled(docs, labels, id_col, text_col, label_col, per_label)
    n = {(r["part"], r["label"]): r["n"] for r in sample.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most four rows
    own = {label: n.get((0, label), 0) + n.get((1, label), 0) for label in (0, 1)}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not own[0] or not own[1]:
        return Lexicon(bias=float(np.log(share / (1 - share))) if 0 < share < 1 else np.inf * (2 * round(share) - 1))
    parted = min(n.get((p, label), 0) for p in (0, 1) for label in (0, 1)) >= HALF
    lexicon = learned(sample.where("part = 0") if parted else sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [matcher.features(t)[:2] for t in batch.column(1).to_pylist()]
            total, rate = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.float64()), pa.array(rate, pa.float64())], names=["label", "total", "rate"])

    rest = sample.where("part = 1") if parted else sample
    got = rest.select("label", "folded").mapInArrow(run, "label int, total double, rate double").toArrow()  # at most 2 * per_label rows
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((got.column("rate").to_numpy(), got.column("total").to_numpy(), y))  # sums of one order: reruns agree
    x = np.column_stack([np.log1p(got.column("total").to_numpy()), np.log1p(100.0 * got.column("rate").to_numpy())])[order]
    w = fitted(x, y[order])
    lexicon.bias = float(w[0] + np.log(sizes[1] / sizes[0]) - np.log(max(1.0, y.sum()) / max(1.0, len(y) - y.sum())))
    lexicon.total, lexicon.rate = float(w[1]), float(w[2])
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, n_hits (words with an entry)."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            for a, b, texts in portions(batch.column(1), 1 << 20):
                found = [matcher.features(t) for t in texts]
                score = pa.array([matcher.score(total, rate) for total, rate, _ in found], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), score, pa.array([n for *_, n in found], pa.int64())], names=["doc_id", "score", "n_hits"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, n_hits bigint")


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = train(docs, labels.where(~crc_is("doc_id", 3, 1)))
    scored = toxicity(docs, lexicon)
    return scored.select(
        "doc_id", crc_is("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_hits"
    )


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLES: dict[str, str] = {}
