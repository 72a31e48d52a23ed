"""Toxicity: folding, matching against plain search, learning, held-out accuracy, odd tables."""

import collections
import re
import zlib

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def test_fold():
    assert t.fold("You 1d10t, ІDІOT (Cyrillic)  and $cum!") == " you idiot idiot cyrillic and scum "
    assert t.fold("l0ser$$$ 455 4ss") == " loser ass " and t.fold("ｉｄｉｏｔ in 2024") == " idiot in "
    assert t.fold("id​iot") == " idiot " and t.fold("") == t.fold(" 12 !") == "  "


LEXICON = t.Lexicon({" scum": 2.0, " scumbag": 3.0, " ass ": 1.5, " trash": 2.5}, {"trash can", "scummy", "a trash"}, -3.0, 1.0, 0.5)


@given(st.lists(st.sampled_from(["scum", "scumbags", "scummy", "ass", "assess", "trash", "can", "a", "TRASH.", "5cum", "other", "12"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_matching_by_plain_search(words):
    folded = t.fold(" ".join(words))
    exempt = [(m.start(), m.start() + len(e) + 2) for e in LEXICON.exceptions for m in re.finditer(f"(?= {e} )", folded)]
    own = {}
    for entry, weight in LEXICON.entries.items():
        for m in re.finditer(f"(?={entry})", folded):
            if not any(a <= m.start() < b - 1 for a, b in exempt):
                own[m.start()] = max(own.get(m.start(), 0.0), weight)
    matcher = t.Matcher(LEXICON)
    assert matcher.hits(folded) == own
    total, rate, n = matcher.features(" ".join(words))
    assert abs(total - sum(own.values())) < 1e-9 and n == len(own) and abs(rate - total / max(1, len(folded.split()))) < 1e-9
    assert 0 <= matcher.score(total, rate) <= 1


def test_op11(spark):
    rows = t.op11_toxicity(spark, SF)
    assert rows.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = rows.collect()
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(list(texts))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.96 * len(held)
    toxic = [r.predicted for r in held if label[r.doc_id]]
    assert toxic and sum(toxic) >= 0.8 * len(toxic)
    assert len({(texts[r.doc_id] or "", r.score) for r in rows}) == len(set(map(lambda x: x or "", texts.values())))
    again = {r.doc_id: r.score for r in t.op11_toxicity(spark, SF).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_odd_tables(spark):
    """No labels, one label, nulls, repeated and contradicting rows, very long texts, clashing columns."""
    schema = "doc_id bigint, text string, label int, `key` int, folded string, score double"
    rows = [(i, f"plain words number {chr(97 + i % 26)}" + " vile" * (i % 2), 1, 2, "x", 0.5) for i in range(80)]
    rows += [(None, "vile", 0, 0, None, None), (3, "vile other", 0, 0, None, None), (3, "vile other", 0, 0, None, None), (200, None, 0, 0, None, None), (201, "", 0, 0, None, None), (202, "vile " + "word " * 600_000, 0, 0, None, None)]
    docs = spark.createDataFrame(rows, schema)

    def scores(labels):
        made = t.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, text string"))
        got = t.toxicity(docs, made).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        return collections.Counter((r.doc_id, r.score) for r in got), made

    assert {s for _, s in scores([])[0]} == {0.0}
    assert {s for _, s in scores([(1, 0, "")])[0]} == {0.0} and {s for _, s in scores([(1, 1, ""), (None, 0, "")])[0]} == {1.0}
    labels = [(i, i % 2, "") for i in range(80)] + [(0, 0, ""), (2, None, ""), (4, 7, ""), (None, 1, "")]
    got, model = scores(labels)
    by = {i: s for i, s in got if i is not None}
    assert " vile" in model.entries and by[1] > 0.7 > 0.3 > by[0] and by[200] == by[201] == by[0] and got[3, by[3]] >= 2
    empty = spark.createDataFrame([], schema)
    assert t.toxicity(empty, t.train(empty, spark.createDataFrame([], "doc_id bigint, toxic int"))).count() == 0


def test_exceptions_are_learned(spark):
    """A word that clean texts have is an exception to an entry that begins it."""
    other = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "pqrst") for i in range(120)]  # else they'd be near copies
    rows = [(i, f"{other[i]} scum{chr(97 + i % 23)}" if i % 2 else f"scum {other[i]}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = t.train(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, toxic int"))
    matcher = t.Matcher(model)
    assert "scum" in model.exceptions and not matcher.hits(t.fold("scum here")) and matcher.hits(t.fold("scumz here")) and matcher.hits(t.fold("5cumz here"))
