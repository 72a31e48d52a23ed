"""Language identification with spans of mixed-language text.

Training: n-gram counts of words (1 to 3 characters, with word boundaries) per language over a
bounded sample - at most ``per_lang`` documents of each language, those with the smallest hash
of identifier and text - give a naive Bayes score per word and language, and the scripts that a
language uses.  All n-grams of the sample are kept and every language with letters in it is
learned, rare ones too; the model's size is bounded by the sample, not by the size of the data.
Only hashes are compared to find the sample: each language's largest hash that still belongs to
it is a number, and texts are filtered by it where they are read.

Prediction: a word's script range leaves some languages as candidates; each gets the word's
score; Viterbi over the words of a text, with a penalty for every switch of language, labels
spans.  A text's language is the one whose spans have most letters, its score their share of
all letters.

Scores come from arrays: characters are numbered, pairs and triples of them are looked up for
a slice of text at once, and a word's score is the sum over its letters.  Long texts are cut
into blocks of words whose best paths are found side by side, for each label before the block,
and joined afterwards; labels are those of one pass.

Defined cases: ``und`` with score 0 for a null text, a text without letters, or when nothing
could be learned; the letters of words of a script that no language uses count for none, only
among all letters, so a text that has no others gets a learned language with score 0;
ties go to the language first by name; every input row gives one row, repeated ones too (the
sample has a row of equal identifier, language and text once).  Texts are used whole; time
grows linearly with them.  Other columns are free, whatever their names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import portions, staged_in_small_batches
from shelfmark.llm.common import col, located, staged, without

# Script by first code point of a range (Unicode blocks).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
STARTS = [a for a, _ in SCRIPTS]
PER_LANG = 1000
SWITCH = 5.0
SPREAD = 12.0
POINTS = 0x110000
#: The boundary of a word in n-gram keys: three symbols of 21 bits, the last one lowest.
EDGE = (1 << 21) - 1
#: Texts are labelled together up to this many bytes, and scored in slices of this many characters.
TOGETHER = 2_000_000
SLICE = 1 << 17
#: Lookup tables up to this many entries are arrays; larger ones are searched.
DENSE = 1 << 22
#: Texts of more words are cut into blocks, if there are few languages.
BLOCK = 256
FEW_LANGS = 16


def script(char: str) -> str:
    return SCRIPTS[bisect.bisect_right(STARTS, ord(char)) - 1][1]


def grams(word: str) -> list[str]:
    """The n-grams of a word; a space is its boundary."""
    w = f" {word} "
    return [*word, *[w[i : i + 2] for i in range(len(w) - 1)], *[w[i : i + 3] for i in range(len(w) - 2)]]


@cache
def letters_and_lower() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter; its lower-case letter."""
    chars = np.arange(POINTS, dtype="<u4").view("<U1")
    lower = np.char.lower(chars).astype("<U1").view("<u4").astype(np.int32)
    return np.char.isalpha(chars), lower


def code_points(text: str) -> np.ndarray:
    """With a line break before and after the text."""
    return np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), "<u4")


def words_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end among the positions of letters (the last letter included)."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    heads = np.flatnonzero(new)
    return heads, np.append(heads[1:], len(at))[: len(heads)] - 1


def gram_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all n-grams of all words, first letters of words with their lengths as pairs)."""
    alpha, lower = letters_and_lower()
    codes = code_points(text)
    letter = alpha[codes]
    at = np.flatnonzero(letter)
    heads, tails = words_of(at)
    symbol = np.where(letter, lower[codes], EDGE).astype(np.int64)
    before, own, after = symbol[at - 1], symbol[at], symbol[at + 1]
    pairs = before << 21 | own
    keys = [own, pairs, own[tails] << 21 | EDGE, pairs << 21 | after]
    return np.concatenate(keys), np.stack([codes[at[heads]].astype(np.int64), tails - heads + 1])


def gram_text(key: int) -> str:
    symbols = [key >> 42 & EDGE, key >> 21 & EDGE, key & EDGE]
    return "".join(" " if s == EDGE else chr(s) for s in symbols if s)


def gram_key(gram: str) -> int:
    key = 0
    for c in gram:
        key = key << 21 | (EDGE if c == " " else ord(c))
    return key


@dataclass
class Model:
    langs: list[str]
    index: dict[str, int]
    weights: np.ndarray  # row 0: unseen; rows by n-gram; columns by language; single precision
    scripts: dict[str, np.ndarray]  # script -> penalty by language


class Lookup:
    """Numbers by key; 0 for keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, size: int, dense: int = DENSE):
        self.table = self.keys = self.values = None
        if size <= dense:
            self.table = np.zeros(size, np.int32)
            self.table[keys] = values
        else:
            order = np.argsort(keys)
            self.keys, self.values = np.append(keys[order], size), np.append(values[order], 0).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[keys]
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], 0)


class Scorer:
    """Scores of words from a model's arrays; this is what workers get."""

    def __init__(self, model: Model, dense: int = DENSE):
        self.langs = model.langs
        alpha, lower = letters_and_lower()
        keys = np.array([gram_key(g) for g in model.index], np.int64)
        rows = np.array(list(model.index.values()), np.int64)
        order = np.argsort(keys)  # single characters, then pairs, then triples
        keys, self.weights = keys[order], model.weights[np.append(0, rows[order])]
        single, double = keys < 1 << 21, (keys >= 1 << 21) & (keys < 1 << 42)
        self.singles = int(single.sum())
        self.symbols = self.singles + 2  # 0: a letter that was never seen; the last: a boundary
        number = np.zeros(POINTS, np.int32)
        number[keys[single]] = np.arange(1, self.singles + 1)
        self.number = np.where(alpha, number[lower], self.symbols - 1).astype(np.int32)
        self.alpha = alpha

        def of(symbol: np.ndarray) -> np.ndarray:
            return np.where(symbol == EDGE, self.symbols - 1, number[np.minimum(symbol, POINTS - 1)]).astype(np.int64)

        pairs, n = keys[double], int(double.sum())
        pair_rows = np.arange(self.singles + 1, self.singles + 1 + n)
        self.pair = Lookup(of(pairs >> 21) * self.symbols + of(pairs & EDGE), pair_rows, self.symbols**2, dense)
        triples = keys[~single & ~double]
        inner = self.pair(of(triples >> 42) * self.symbols + of(triples >> 21 & EDGE)) - self.singles
        self.triple = Lookup(inner * self.symbols + of(triples & EDGE), np.arange(self.singles + 1 + n, len(keys) + 1), (n + 1) * self.symbols, dense)
        none = np.zeros(len(self.langs))
        self.penalty = np.array([model.scripts.get(s, none) for _, s in SCRIPTS])
        self.native = np.array([s in model.scripts for _, s in SCRIPTS])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores, position, letters, whether a language uses the script) of each word of a text.

        Scores (words x languages) are 0 for the best language of a word, -SPREAD at least.
        """
        codes = code_points(text)
        at = np.flatnonzero(self.alpha[codes])
        heads, tails = words_of(at)
        if not len(at):
            return np.zeros((0, len(self.langs)), np.float32), at, at, np.zeros(0, bool)
        number = self.number[codes]
        own = number[at]
        pair = self.pair(number[at - 1].astype(np.int64) * self.symbols + own)
        triple = self.triple(np.maximum(pair - self.singles, 0).astype(np.int64) * self.symbols + number[at + 1])
        total = self.weights[own]
        total += self.weights[pair]
        total += self.weights[triple]
        out = np.add.reduceat(total, heads, axis=0)
        out += self.weights[self.pair(own[tails].astype(np.int64) * self.symbols + self.symbols - 1)]
        kind = np.searchsorted(STARTS, codes[at[heads]], side="right") - 1
        native = self.native[kind]
        out += self.penalty[kind]
        out[~native] = 0.0
        out = np.maximum(out - out.max(axis=1, keepdims=True), -SPREAD).astype(np.float32)
        return out, at[heads] - 1, tails - heads + 1, native


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = PER_LANG) -> Model | None:
    """Fit the model on at most ``per_lang`` documents of each language."""
    spark = docs.sparkSession
    lang, text = col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")
    labelled = docs.select(lang, text, F.xxhash64(col(id_col), text).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    hashes = staged(labelled.select("lang", "h"), "hashes")
    counts = hashes.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row per language
    # the sample ends below this hash, or it is the whole language
    rough = [(r["lang"], min((1 << 63) - 1, int((2.0 * per_lang / r["n"] + 1e-6) * (1 << 64)) - (1 << 63))) for r in counts if r["n"]]
    if not rough:
        return None

    def below(rows: DataFrame, ends: list[tuple[str, int]]) -> DataFrame:
        table = spark.createDataFrame(ends, "lang string, most bigint")  # a row per language
        return rows.join(F.broadcast(table), "lang").where("h <= most").drop("most")

    few = below(hashes, rough).distinct().toArrow()  # hashes only: about twice the sample
    langs, h = np.array(few.column("lang").to_pylist()), few.column("h").to_numpy()
    ends = []
    for name in sorted(set(langs.tolist())):
        own = np.sort(h[langs == name])
        ends.append((name, int(own[min(per_lang, len(own)) - 1])))
    # equal rows have one hash; they meet here, summed up where they are read
    sample = below(labelled, ends).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array(batch.column(0).to_pylist())
            for a, b, texts in portions(batch.column(1), SLICE):
                for name in sorted(set(of[a:b].tolist())):
                    keys, starts = gram_keys("\n".join(t for t, l in zip(texts, of[a:b], strict=True) if l == name))
                    key, n = np.unique(keys, return_counts=True)
                    kind = np.searchsorted(STARTS, starts[0], side="right")  # scripts are counted under keys below 0
                    mass = np.bincount(kind, weights=starts[1], minlength=1).astype(np.int64)
                    used = np.flatnonzero(mass)
                    cols = [pa.array([name] * (len(key) + len(used)), pa.string()), pa.array(np.append(key, -used)), pa.array(np.append(n, mass[used]))]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # bounded by the sample; one row at least of each language with letters
    names, gram, n = np.array(rows.column("lang").to_pylist(), object), rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    langs = sorted(set(names.tolist()))
    if not langs:
        return None
    place = {name: i for i, name in enumerate(langs)}
    at = np.array([place[name] for name in names])
    kinds, row = np.unique(gram[gram > 0], return_inverse=True)
    table = np.zeros((len(kinds) + 1, len(langs)))
    table[row + 1, at[gram > 0]] = n[gram > 0]
    weights = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table))).astype(np.float32)
    used: dict[str, np.ndarray] = {}
    for key, i, mass in zip((-gram[gram < 0]).tolist(), at[gram < 0].tolist(), n[gram < 0].tolist(), strict=True):
        used.setdefault(SCRIPTS[key - 1][1], np.zeros(len(langs)))[i] += mass
    letters = sum(used.values())
    scripts = {s: np.where(m > 0.01 * letters, 0.0, -100.0) for s, m in used.items() if (m > 0.01 * letters).any()}
    return Model(langs, {gram_text(k): i for i, k in enumerate(kinds.tolist(), 1)}, weights, scripts)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """Best label of each word of many texts at once.

    scores: the words of all texts, one text after the other (words x languages).  Texts of
    more than ``block`` words are cut into blocks; every block but the first is followed once for
    each label that may come before it.  All blocks advance together, word by word; the longest
    come first, so those still running are a prefix.
    """
    langs = scores.shape[1]
    kind = np.int8 if langs < 128 else np.int32
    labels = np.zeros(len(scores), kind)
    if not len(scores):
        return labels
    if langs > FEW_LANGS:
        block = max(int(lengths.max()), 1)
    lengths = lengths.astype(np.int64)
    parts = -(-lengths // block)
    of = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)  # of a block in its text
    b_start = np.repeat(np.cumsum(lengths) - lengths, parts) + number * block
    b_size = np.minimum(block, np.repeat(lengths, parts) - number * block)
    copies = np.where(number > 0, langs, 1)
    item = np.cumsum(copies) - copies  # a block's first copy
    which = np.repeat(np.arange(len(of)), copies)
    entry = np.arange(len(which)) - item[which]
    order = np.argsort(-b_size[which], kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    begin, sizes = b_start[which][order], b_size[which][order]
    inside, came = number[which][order] > 0, entry[order]
    own = np.cumsum(sizes) - sizes  # of each copy's words among those of all
    longest = int(sizes[0])
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")  # copies longer than t
    state = scores[begin].astype(np.float64)
    state[inside] += np.where(np.arange(langs) == came[inside, None], 0.0, -switch)
    best = np.zeros(int(sizes.sum()), kind)  # the best label before this word
    jump = np.zeros((len(best), langs), bool)  # whether a label at this word comes from there
    ends = np.zeros((len(order), langs))
    for t in range(1, longest):
        n = running[t]
        if n < len(state):
            ends[n : len(state)] = state[n:]
            state = state[:n]
        at = own[:n] + t
        top = state.argmax(axis=1)
        over = state[np.arange(n), top] - switch
        come = over[:, None] > state
        best[at], jump[at] = top, come
        state = np.where(come, over[:, None], state) + scores[begin[:n] + t]
    ends[: len(state)] = state
    # the copy of each block that is on the best path, and the label at its end
    chosen, last = item.copy(), np.zeros(len(of), np.int64)
    first = np.flatnonzero(number == 0)
    value = ends[back[item[first]]]  # by text with words
    rank = np.cumsum(number == 0) - 1  # of a block's text among these
    from_label = np.zeros((len(of), langs), np.int64)
    for k in range(1, int(number.max()) + 1):
        now = np.flatnonzero(number == k)
        through = value[rank[now], :, None] + ends[back[item[now][:, None] + np.arange(langs)]]
        from_label[now], value[rank[now]] = through.argmax(axis=1), through.max(axis=1)
    label = value.argmax(axis=1)
    for k in range(int(number.max()), -1, -1):
        now = np.flatnonzero(number == k)
        last[now] = label[rank[now]]
        if k:
            came_from = from_label[now, last[now]]
            chosen[now] = item[now] + came_from
            label[rank[now]] = came_from
    path = back[chosen]
    order = np.argsort(-b_size, kind="stable")
    path, last, begin, sizes = path[order], last[order].astype(kind), b_start[order], b_size[order]
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")
    current, begun = np.zeros(len(last), kind), 0
    for t in range(longest - 1, -1, -1):
        n = running[t]
        current[begun:n] = last[begun:n]  # blocks that end with this word
        begun = n
        labels[begin[:n] + t] = current[:n]
        if t:
            at = own[path[:n]] + t
            current[:n] = np.where(jump[at, current[:n]], best[at], current[:n])
    return labels


class Labeller:
    """Predicts texts in portions."""

    def __init__(self, model: Model | Scorer):
        self.score = model if isinstance(model, Scorer) else Scorer(model)
        self.names = pa.array([*self.score.langs, "und"], pa.string())

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, scores, position, letters, native) of the words of all texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        whole, found, a = "\n".join(texts), [], 0
        while a < len(whole) or not found:
            b = a + SLICE
            while b < len(whole) and whole[b].isalpha():
                b += 1
            scores, at, letters, native = self.score(whole[a:b])
            found.append((scores, at + a, letters, native))
            a = b
        scores, at, letters, native = (np.concatenate(x) for x in zip(*found, strict=True))
        of = np.searchsorted(starts, at, side="right") - 1
        return of, scores, at - starts[of], letters, native

    def label(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Arrays of languages, scores and spans (language, start, end)."""
        texts = [t or "" for t in texts]
        langs = len(self.score.langs)
        of, scores, at, letters, native = self.words(texts)
        label = viterbi(scores, np.bincount(of, minlength=len(texts))).astype(np.int64)
        whole = np.bincount(of, weights=letters, minlength=len(texts))
        mass = np.bincount(of * langs + label, weights=letters * native, minlength=len(texts) * langs).reshape(-1, langs)
        top = np.where(whole > 0, mass.argmax(axis=1), langs)
        value = np.where(whole > 0, mass.max(axis=1) / np.maximum(whole, 1), 0.0).round(6)
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (label[1:] != label[:-1])
        cut = np.flatnonzero(new)
        text = of[cut]
        first = np.ones(len(cut), bool)
        first[1:] = text[1:] != text[:-1]
        start = np.where(first, 0, at[cut])
        stop = np.array([len(t) for t in texts], np.int64)[text]
        stop[:-1] = np.where(first[1:], stop[:-1], start[1:])
        fields = [self.names.take(pa.array(label[cut])), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))]
        offsets = np.append(0, np.cumsum(np.bincount(text, minlength=len(texts)))).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["lang", "start", "end"]))
        return self.names.take(pa.array(top)), pa.array(value), spans

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, score, spans as (language, start, end)) of each text."""
        lang, value, spans = (x.to_pylist() for x in self.label(texts))
        return [(a, b, [(s["lang"], s["start"], s["end"]) for s in c]) for a, b, c in zip(lang, value, spans, strict=True)]


def nothing(n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """What texts get if nothing was learned."""
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array(["und"] * n, pa.string()), pa.array([0.0] * n, pa.float64()), pa.array([[]] * n, span)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", *carry: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, spans, and the columns to carry."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"), *carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    schema = f"{fields}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model) if model else None)  # bounded by the sample
    kept = [i for i, c in enumerate(rows.columns) if c != "text"]
    names = [*[rows.columns[i] for i in kept], "lang_pred", "score", "spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            for a, b, texts in portions(batch.column(1), TOGETHER):
                got = labeller.label(texts) if labeller else nothing(len(texts))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in kept], *got], names=names)

    return rows.mapInArrow(run, schema)


#: A text is kept when its language holds at least this share of its letters.
MIN_SCORE = 0.4


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with its columns; trained on ``docs``."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    base = located(docs, id=col(id_col), text=col(text_col))
    found = identify(base, model, "id", "text", F.col("file"), F.col("row"))
    gone = found.where((F.col("lang_pred") == "und") | (F.col("score") < min_score)).select("file", "row")
    return without(base, staged_in_small_batches(gone, "rejected"))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its identifier as text."""
    return F.coalesce(F.crc32(col(id_col).cast("string")), F.lit(0)) % folds == 0


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans")
    )


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
