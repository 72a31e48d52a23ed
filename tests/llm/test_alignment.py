"""Alignment of two tokenizers against plain loops over all token pairs."""

import collections
import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from shelfmark.llm import alignment

SF = "/root/testdata/sf0.001"


def byte_level():
    """The byte of each character of byte-level BPE: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b, to_byte = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_level()
    assert isinstance(a.decoder, decoders.ByteLevel)
    documents, linked = [], collections.Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            tokens = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids[0]], [
                bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids[1])
            ]
            if b"".join(tokens[0]) == b"".join(tokens[1]) == f" {text}".encode():
                i = j = x = y = 0
                own = [], []
                while i < len(ids[0]) or j < len(ids[1]):
                    if x <= y and i < len(ids[0]):
                        x, i = x + len(tokens[0][i]), i + 1
                        own[0].append(ids[0][i - 1])
                    else:
                        y, j = y + len(tokens[1][j]), j + 1
                        own[1].append(ids[1][j - 1])
                    if x == y and own[0] and own[1]:
                        groups.append(own)
                        own = [], []
        documents.append((doc_id, groups))
        linked.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    top = collections.Counter()
    for (p, _), n in linked.items():
        top[p] = max(top[p], n)
    out = collections.Counter()
    for doc_id, groups in documents:
        counts = [(p, linked[p, q]) for g in groups for p in g[0] for q in g[1]]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out[
            doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(counts), sum(n == top[p] for p, n in counts),
            sum(n for _, n in counts), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ] += 1
    return out


def test_op13(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = alignment.op13_alignment(spark, SF)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    assert got.dtypes == [("doc_id", "bigint"), *[(n, "bigint") for n in names], ("groups_sha256", "string")]
    assert collections.Counter(map(tuple, got.collect())) == brute([(r["doc_id"], r["text"]) for r in table])


@pytest.mark.parametrize("head", [0, 5, 100_000])
def test_odd_texts(spark, monkeypatch, head):
    """Nulls, empty texts, special tokens as text, bytes, runs, repeated rows; with small dictionaries too."""
    monkeypatch.setattr(alignment, "HEAD", head)
    monkeypatch.setattr(alignment, "DICTIONARY", 50 if head == 5 else 200_000)
    texts = [
        None, "", " ", "  two  spaces ", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 Ünïcode 🙂🙂 ▁ x", "a\x00b\r\n\tc", "=" * 500, "aaaaaaa " * 60, "the cat sat. " * 40,
        "ﬁne ｆｕｌｌ ½", "the cat sat. " * 40, "é" + "́" * 5, "​﻿", " " * 3000,
    ]
    rows = [(i if i != 3 else None, t, 1, 2) for i, t in enumerate(texts)] + [(9, texts[9], 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rid int, `groups` int")
    got = collections.Counter(map(tuple, alignment.align(docs).collect()))
    assert got == brute([r[:2] for r in rows])


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_groups_that_never_end(spark):
    """A group's pairs come from its distinct ids; its links are counted all the same."""
    a, b = alignment.expanded("1,1,1,2|5,5,6")
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {(1 << 32) + 5: 6, (1 << 32) + 6: 3, (2 << 32) + 5: 2, (2 << 32) + 6: 1}


def test_very_long_text(spark):
    text = "one two three, " * 60_000
    rows = [(1, text), (2, " " * 1_200_000 + "x"), (3, "short")]
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_groups > 100_000 and got[3].n_groups > 0 and (got[2].n_a == 0) == (got[2].groups_sha256 == "")
