"""Personal data, language, WARC, MPEG audio, packing, near-duplicates, repeats: brute force and round trips."""

import base64
import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import langid, mpeg_audio, near_dedup, packing, pii, repeats, suffix_array, warc


def docs(spark, rows):
    data = [(i, t, "x", 1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, id string, key int").repartition(3)


# --- personal data ----------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    out = []
    for kind, regex in BASE.items():
        for m in regex.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aé@.+-_ 0123459%()\n"), max_size=60))
def test_base_spans_random(text):
    assert [s[:3] for s in pii.find(text) if s[0] in BASE] == base_spans(text)


def test_pii_cases():
    text = "mail a.b@c.de, 4111 1111 1111 1111, ip 1.2.3.255 1.2.3.256, +1 (499) 555-6503, IBAN DE89 3704 0044 0532 0130 00 OK, ssn 123-45-6789, 987-65-4321x"
    found = pii.find(text)
    assert [s[0] for s in found if s[0] in BASE] == [s[0] for s in base_spans(text)]
    kinds = {s[0]: text[s[1] : s[2]] for s in found}
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00" and kinds["ssn"] == "123-45-6789"
    assert "ssn" not in {s[0] for s in pii.find("number 123-45-6789 here")}
    assert "iban" not in {s[0] for s in pii.find("DE88 3704 0044 0532 0130 00")}
    near, plain = (next(s[3] for s in pii.find(t) if s[0] == "card") for t in ("credit card 4111111111111111", "order 4111111111111111"))
    assert near > plain and pii.find(None) == []
    assert pii.redact("to a@b.c now", pii.find("to a@b.c now")) == "to [email] now"
    for long in ("1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "A1" * 100_000, "1 " * 100_000):
        pii.find(long)  # linear


@pytest.mark.parametrize("iban", [
    "TR330006100519786457841326", "SA0380000000608010167519", "AE070331234567890123456", "IL620108000000099999999", "HR1210010051863000160",
    "SK3112000000198742637541", "SI56263300012039086", "LT121000011101001000", "LV80BANK0000435195001", "EE382200221020145685",
    "CY17002001280000001200527600", "MT84MALT011000012345MTLCAST001S", "LC55HEMM000100010012001200023015", "BR1800360305000010009795493C1",
])
def test_pii_iban_registry(iban):
    spaced = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
    for text in (iban, spaced):
        assert [f"to {text} now"[s[1] : s[2]] for s in pii.find(f"to {text} now") if s[0] == "iban"] == [text]
    wrong = iban[:2] + f"{(int(iban[2:4]) + 1) % 100:02}" + iban[4:]
    assert "iban" not in {s[0] for s in pii.find(wrong)}


def test_pii_query(spark):
    rows = [(1, "x@y.zz"), (1, "x@y.zz"), (None, None), (2, "")]
    got = pii.pii_spans(docs(spark, rows)).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 1, 1]
    assert pii.pii_spans(docs(spark, [])).count() == 0


# --- language ---------------------------------------------------------------------------------


def viterbi_one(scores, penalty):
    state, back = scores[0].copy(), []
    for s in scores[1:]:
        top = state.argmax()
        come = state[top] - penalty > state
        back.append(np.where(come, top, np.arange(len(state))))
        state = np.where(come, state[top] - penalty, state) + s
    out = [int(state.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(100):
        lengths = rng.integers(0, 12, rng.integers(1, 9))
        scores = -rng.random((lengths.sum(), 3)) * 6
        cuts = np.split(scores, np.cumsum(lengths)[:-1])
        assert langid.viterbi(scores, lengths, 3.0).tolist() == [x for c in cuts if len(c) for x in viterbi_one(c, 3.0)]


def test_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table.where(~langid.held_out()))
    got = langid.identify(table.where(langid.held_out()), model, "doc_id", "text", F.col("lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)
    rows = [(1, None), (2, ""), (3, "123 !? ²"), (4, "the this that with from"), (4, "the this that with from"), (None, "Привет мир")]
    out = collections.Counter((r.doc_id, r.lang_pred) for r in langid.identify(docs(spark, rows), model).collect())
    assert out[1, "und"] == out[2, "und"] == out[3, "und"] == 1 and out[4, "en"] == 2
    texts = {r.lang: r.text for r in table.where("length(text) > 2000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = texts["en"][:1500] + "\n" + texts["de"][:500]
    row = langid.identify(docs(spark, [(1, mixed)]), model).first()
    assert row.lang_pred == "en" and {s.lang for s in row.spans if s.end - s.start > 200} == {"en", "de"}
    assert row.spans[0].start == 0 and row.spans[-1].end == len(mixed) and all(a.end == b.start for a, b in itertools.pairwise(row.spans))
    assert langid.identify(docs(spark, [(1, "x")]), None).first().lang_pred == "und"
    assert langid.train(table.limit(0)) is None
    kept = langid.keep_identified(table)
    assert kept.columns == table.columns and kept.count() >= 0.99 * table.count()


def test_unlearned_script(spark):
    rows = [(i, t, lang) for i in range(20) for lang, t in (("de", "der Hund und die Katze"), ("en", "the dog and the cat"))]
    rows += [(100, "Привет мир", None), (101, "你好世界", None), (102, "the dog Привет дорогой мир", None), (103, "the dog and the cat мир", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    kept = {r.doc_id for r in langid.keep_identified(table).collect()}
    assert kept == {*range(20), 103}
    score = {r.doc_id: r.score for r in langid.identify(table.where("lang IS NULL"), langid.train(table)).collect()}
    assert score == {100: 0.0, 101: 0.0, 102: round(6 / 22, 6), 103: round(15 / 18, 6)}
    assert langid.keep_identified(table).count() == 41


def test_rare_language(spark):
    rng, letters = np.random.default_rng(3), np.array(list("abcdefghijklmnopqrstuvwxyzäöüßéèêçñåøæ"))
    alphabets = {f"l{i}": rng.choice(letters, 24, replace=False) for i in range(7)} | {"rare": letters[-20:]}

    def text(lang, n):
        return " ".join("".join(w) for w in rng.choice(alphabets[lang], (n, 7)))

    rows = [(i, text(f"l{i % 7}", 2500), f"l{i % 7}") for i in range(210)] + [(1000 + i, text("rare", 30), "rare") for i in range(4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.index) > 15_000 and np.count_nonzero(model.weights > model.weights[0]) > 60_000
    assert model.langs == sorted(alphabets)
    own = collections.Counter(g for _, t, lang in rows if lang == "rare" for w in t.split() for g in langid.grams(w))
    at = model.langs.index("rare")
    assert all(model.weights[model.index[g], at] > model.weights[0, at] for g in own)
    got = langid.Labeller(model).predict([text("rare", 12) for _ in range(40)] + [text("l0", 12) for _ in range(40)])
    assert [g[0] for g in got].count("rare") >= 36 and [g[0] for g in got[40:]].count("l0") >= 36


def test_many_languages():
    scores = np.full((3, 200), -9.0)
    scores[:, 150] = 0
    assert langid.viterbi(scores, np.array([2, 1])).tolist() == [150] * 3


# --- WARC -------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = [
        (5, "http://x/ü y", "same"), (2, "http://x", "same"), (2, "http://x", "same"), (9, None, "same"), (3, "u", ""), (4, "u", None), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
        (7, "u", "ends\r\n"), (8, "u", "ends\r\n\r\n"), (10, "u", "é" * 100_001 + "\r\n" * 9), (None, "u", "same"), (None, "u", "nulls"), (11, "u", "x" * (1 << 16)),
    ]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id bigint, url string, html string, payload string").repartition(4)
    path = str(tmp_path / "warc")
    warc.write_archives(df, path)
    chunks = warc.read_archives(spark, path).collect()
    payload = collections.defaultdict(bytes)
    last = [c for c in chunks if c.is_last]
    assert len(last) == len(pages)
    got = collections.Counter((c.page_id, c.bytes_so_far, c.digest_so_far, c.record_type, c.refers_to) for c in last)
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    expected = collections.Counter()
    for i, _, h in pages:
        raw, ids = (h or "").encode(), [x for x in groups[h or ""] if x is not None]
        revisit = bool(ids) and i != min(ids)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected[None if i is None else str(i), len(raw), digest, "revisit" if revisit else "response", str(min(ids)) if revisit else None] += 1
    assert got == expected
    assert max(len(c.data) for c in chunks) <= warc.CHUNK_BYTES
    for c in sorted((c for c in chunks if c.page_id == "10"), key=lambda c: c.chunk_no):
        payload[10] += c.data
        assert base64.b32encode(hashlib.sha1(payload[10]).digest()).decode() == c.digest_so_far
    assert payload[10].decode() == pages[9][2]
    warc.write_archives(df.limit(0), path + "-empty")
    assert warc.read_archives(spark, path + "-empty").count() == 0


# --- MPEG audio -------------------------------------------------------------------------------


def test_mpeg_round_trip(spark):
    for n in (0, 1, 58, 59, 64, 922, 923, 50_000):
        for raw in (bytes(n), os.urandom(n), b"\xff\xfa" * (n // 2)):
            p = mpeg_audio.probe(mpeg_audio.store(raw))
            assert p.payload == raw and p.crc_bad == p.resyncs == 0 and p.tag_crc_ok and p.vbr[0] == len(p.offsets) + 1
            assert p.duration == len(p.offsets) * mpeg_audio.Fraction(3, 125)
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7
    data = bytearray(mpeg_audio.store(os.urandom(9000)))
    clean = mpeg_audio.probe(bytes(data))
    damaged = data[: clean.offsets[3]] + b"junk\xff\xfb" * 5 + data[clean.offsets[3] :]
    p = mpeg_audio.probe(bytes(damaged))
    assert p.resyncs >= 1 and len(p.offsets) >= len(clean.offsets) - 1
    data[clean.offsets[2] + 10] ^= 1  # side information
    assert mpeg_audio.probe(bytes(data)).crc_bad == 1
    assert mpeg_audio.probe(b"").payload is None and mpeg_audio.probe(b"ID3").duration == 0
    rows = [(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (4, "x" * 300_000), (None, "a")]
    got = mpeg_audio.probe_media(mpeg_audio.store_texts(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        raw = text.encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and len(r.seek_offsets) == r.frames
    assert mpeg_audio.store_texts(docs(spark, [])).count() == 0


# --- packing ----------------------------------------------------------------------------------


def test_encoder_is_that_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encode = packing.encoder(packing.byte_bpe_50k()).encode_ordinary
    rng = random.Random(0)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "!", "文", "😀", " ", " ", "\x1c", "²", "<|endoftext|>", "́", "_", "ß"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [" " * 5000 + "x", "ab" * 5000]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [encode(x) for x in texts]


def test_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, path = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.byte_bpe_50k()
    assert packing.encode(path, "a<|endoftext|>") == [64, 50256]
    rng = random.Random(1)
    alphabet = ["a", "é", " ", "  ", "\n", "'s", "12", "!", "文", "😀", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<|", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|>" * 3000, "<|endoftext|>"]
    expected = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [packing.encode(path, x) for x in texts] == expected
    rows = list(enumerate(texts[-40:]))
    got = collections.defaultdict(list)
    for r in packing.pack(docs(spark, rows), with_ids=True).collect():
        got[r.doc_id].append((r.start, r.ids))
    for (i, _), ids in zip(rows, expected[-40:], strict=True):
        assert np.frombuffer(b"".join(raw for _, raw in sorted(got[i])), "<u4").tolist() == [*ids, packing.END_ID]


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        room = min(fit) if fit else capacity
        if fit:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


def test_plan():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 50, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 15))}
        fill, upto = collections.Counter(), collections.Counter()
        for r in packing.plan_best_fit(counts, capacity):
            assert r.first == upto[r.length]
            upto[r.length] = r.last
            for k in range(r.last - r.first):
                s = r.sequence + k // r.per
                assert fill[s] == r.offset + k % r.per * r.length
                fill[s] += r.length
                assert fill[s] <= capacity
        assert dict(upto) == counts and len(fill) == best_fit_decreasing([n for n, c in counts.items() for _ in range(c)], capacity)


def test_pack(spark):
    rows = [(i, "word " * (i * 37 % 500)) for i in range(200)] + [(1, None), (2, ""), (3, "long text " * 9000), (None, "x"), (None, "x")]
    got = packing.pack(docs(spark, rows), with_ids=True).collect()
    encode = packing.encoder(packing.byte_bpe_50k()).encode_ordinary
    pieces = collections.Counter()
    for i, t in rows:
        ids = np.array([*encode(t or ""), 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            pieces[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    sequences = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 2048
    assert len(sequences) == best_fit_decreasing([r.length for r in got], 2048)
    assert packing.pack(docs(spark, [])).count() == 0


# --- near-duplicates --------------------------------------------------------------------------


def brute_similarity(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in set(x) & set(y))


def shingles_of(text):
    words = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(words))
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else collections.Counter()


def near_rows():
    rng, rows = random.Random(5), []
    for base in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 60, 200]))] * rng.choice([1, 1, 3])
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randint(0, 1 + len(own) // 30)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, "!!!"), (903, "???"), (904, "!!!"), (None, rows[0][1].upper()), (905, rows[7][1]), (905, rows[7][1])]


@pytest.mark.parametrize("bound", [{}, {"group_rows": 2}])
def test_near_dedup(spark, bound):
    rows = near_rows()
    got = near_dedup.near_dedup(docs(spark, rows), **bound).collect()
    assert len(got) == len(rows)
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets, parent = [shingles_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (sets[a] and brute_similarity(sets[a], sets[b]) >= 0.8) or (not sets[a] and texts[a] == texts[b]):
            parent[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for i, t in rows:
        classes[find(texts.index(t or ""))].append(i)
    lowest = lambda ids: None if None in ids else min(ids)
    expected = collections.Counter((i, lowest(ids), len(ids)) for ids in classes.values() for i in ids)
    assert collections.Counter((r.id, r.class_id, r.class_size) for r in got) == expected
    assert sum(r.representative for r in got) == len(classes)


def test_candidates_that_cannot_be_near(monkeypatch):
    """Many copies of one page, each changed too much: all pairs are candidates, few are verified."""
    rng = np.random.default_rng(3)
    page, sets = np.sort(rng.integers(0, 1 << 60, 300).astype("u8")), []
    for k in range(400):
        kept = page[rng.random(300) > rng.uniform(0, 0.3)]
        own = rng.integers(0, 1 << 60, 300 - len(kept)).astype("u8")
        hashes = np.sort(np.concatenate([kept, own]))
        sets.append((hashes, rng.integers(1, 4, len(hashes)).astype("u4") if k % 10 == 0 else np.ones(len(hashes), "u4")))
    calls, exact = [], near_dedup.probability_jaccard
    monkeypatch.setattr(near_dedup, "probability_jaccard", lambda a, b: calls.append(1) or exact(a, b))
    got = near_dedup.components(np.zeros((400, near_dedup.BANDS), np.int64), sets, 0.8)
    expected = np.arange(400)
    for i, j in itertools.combinations(range(400), 2):
        if expected[i] != expected[j] and exact(sets[i], sets[j]) >= 0.8:
            expected[expected == expected[j]] = expected[i]
    assert len(set(zip(got, expected, strict=True))) == len(set(got)) == len(set(expected)) > 100
    assert len(calls) < 2000  # of 79,800 pairs


def test_near_dedup_keeps_columns(spark):
    df = docs(spark, near_rows())
    assert near_dedup.keep_one(df).schema == df.schema
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0


def test_prob_minhash_estimates():
    rng = np.random.default_rng(2)
    n, shared, m = 400, 250, 4000
    value = rng.integers(1, 2**62, n + shared).astype(np.uint64)
    a, b = np.sort(value[:n]), np.sort(value[n - shared :])
    wa, wb = rng.integers(1, 6, len(a)), rng.integers(1, 6, len(b))
    signs = near_dedup.prob_minhash(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, m)
    exact = near_dedup.probability_jaccard((a, wa), (b, wb))
    assert abs((signs[0] == signs[1]).mean() - exact) < 4 * (0.25 / m) ** 0.5
    x, y = (collections.Counter(dict(zip(h.tolist(), w.tolist(), strict=True))) for h, w in ((a, wa), (b, wb)))
    assert abs(exact - brute_similarity(x, y)) < 1e-9


# --- repeats ----------------------------------------------------------------------------------


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(150):
        lengths = rng.integers(0, 40, rng.integers(1, 7))
        text = rng.integers(97, 97 + rng.integers(1, 5), lengths.sum()).astype(np.uint8)
        first = np.cumsum(lengths) - lengths
        expected = []
        for f, n in zip(first, lengths, strict=True):
            raw = text[f : f + n].tobytes()
            expected += [f + i for i in sorted(range(n), key=lambda i: raw[i:])]
        assert suffix_array.suffix_arrays(text, first, lengths).tolist() == expected


def brute_repeats(rows, n=50):
    seen, out = {}, collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - n + 1):
            key = -1 if i is None else i
            seen[raw[p : p + n]] = min(seen.get(raw[p : p + n], key), key)
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if seen[raw[p : p + n]] < (-1 if i is None else i):
                gone[p : p + n] = b"\1" * n
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i, len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest] += 1
    return out


def repeat_rows():
    rng = random.Random(9)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 200))) for _ in range(6)]
    rows = []
    for _ in range(80):
        parts = [rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(4)]
        rows.append((rng.randint(0, 60), "".join(parts)))
    rows += [(70, rows[0][1]), (3, rows[1][1]), (None, passages[0]), (71, None), (72, ""), (73, "a" * 500), (74, "a" * 60), (75, "x" * 49), (76, "x" * 49), (77, "y" * 50), (78, "y" * 50)]
    # many different contexts of one anchor, some of them shared, and long runs of one byte
    common = "the very same anchor of bytes"
    sides = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(25)]
    rows += [(100 + i, rng.choice(sides) + common + rng.choice(sides)) for i in range(150)]
    return rows + [(300, "z" * 5000), (301, "z" * 1234 + "ab" * 700), (302, "ba" * 900 + "z" * 77)]


@pytest.mark.parametrize("lane", [4096, 400, 401])
def test_repeats(spark, lane, monkeypatch):
    rows = repeat_rows()
    monkeypatch.setattr(repeats, "LANE", lane)
    monkeypatch.setattr(repeats, "FEW_LONG", 0 if lane == 400 else 100_000)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, id string, key int").repartition(3)
    got = repeats.repeated(frame, with_text=True).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == brute_repeats(rows)
    if lane == 4096:
        assert repeats.repeated(docs(spark, [])).count() == 0


def test_repeats_tells_contexts_apart(spark):
    """Two contexts under one name are noticed."""
    text = "the same words again and again, for more than fifty bytes, "
    rows = [(1, text + "x" * 20), (2, text + "y" * 20), (3, "z" * 20 + text)]
    found = [(7, t.encode(), i) for i, t in rows]
    frame = spark.createDataFrame(found, "hash bigint, context binary, id bigint")
    kinds = repeats.distinct_contexts(frame, 1)
    assert repeats.smallest_of_windows(repeats.staged(kinds, "kinds"), 50, 1).count() == 2  # the first one loses nothing
    kinds = repeats.distinct_contexts(frame, 1).withColumn("name", F.lit(0).cast("long"))
    assert repeats.smallest_of_windows(repeats.staged(kinds, "kinds"), 50, 1) is None


# --- streams and archives of other writers ----------------------------------------------------


def test_foreign_warc(spark, tmp_path):
    import gzip

    def record(kind, block, *fields):
        head = "\r\n".join(["WARC/1.0", f"warc-type: {kind}", f"Warc-Record-Id: <urn:{kind}>", *fields, f"CONTENT-LENGTH:{len(block)}"])
        return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\ncontent-length:5\r\nX: \xff\r\n\r\nh\x00\xfelo"
    said = base64.b32encode(hashlib.sha1(http).digest()).decode()
    parts = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", http, "Content-Type: application/http;", "  msgtype=response", f"WARC-Block-Digest: SHA1:{said}"),
        record("resource", b"", "Content-Type: text/plain"), record("metadata", b"a: b\r\n\r\nc: d", "WARC-Payload-Digest: md5:x"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    rows = {r.record_type: r for r in warc.read_archives(spark, str(tmp_path / "a.warc.gz")).collect()}
    assert {k: (r.bytes_so_far, bytes(r.data), r.is_last) for k, r in rows.items()} == {
        "warcinfo": (13, b"software: x\r\n", True), "request": (0, b"", True), "response": (5, b"h\x00\xfelo", True), "resource": (0, b"", True),
        "metadata": (12, b"a: b\r\n\r\nc: d", True),
    }
    (tmp_path / "bad.warc.gz").write_bytes(record("response", b"x", f"WARC-Block-Digest: sha1:{said}"))
    with pytest.raises(Exception, match="digest differs"):
        warc.read_archives(spark, str(tmp_path / "bad.warc.gz")).collect()


def test_foreign_mpeg():
    def size(n):
        return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))

    frame = mpeg_audio.frame_head(5, False)
    length = mpeg_audio.header(frame[:4]).length
    vbri = (frame + b"VBRI" + bytes(6) + (9000).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\1abcd").ljust(length, b"\0")
    audio = vbri + frame.ljust(length, b"\0") * 3
    text = b"TT2" + (6).to_bytes(3, "big") + b"\0title"
    v22 = b"ID3\2\0\0" + size(len(text)) + text
    frames24 = b"TIT2" + size(200) + b"\0\0" + b"\0" + b"t" * 199 + b"TPE1" + size(4) + b"\0\2" + b"\xff\0\xfbx"
    v24 = b"ID3\4\0\x10" + size(len(frames24)) + frames24 + b"3DI\4\0\x10" + size(len(frames24))
    raw = b"TIT2" + (3).to_bytes(4, "big") + b"\0\0" + b"\xff\xfaq"
    unsynchronised = raw.replace(b"\xff", b"\xff\0")
    v23 = b"ID3\3\0\x80" + size(len(unsynchronised)) + unsynchronised
    for tag, kind, names in ((v22, "ID3v2.2", ["TT2"]), (v24, "ID3v2.4", ["TIT2", "TPE1"]), (v23, "ID3v2.3", ["TIT2"])):
        p = mpeg_audio.probe(tag + audio)
        assert (p.tags, p.frames, p.vbr, p.toc, len(p.offsets), p.resyncs) == ([kind], names, (7, 9000), b"abcd", 3, 0)


def test_pii_languages():
    found = {s[0]: s[3] for s in pii.find("Überweisung auf de89 3704 0044 0532 0130 00 bitte; tarjeta 4111111111111111")}
    assert found["iban"] == 1.0 and found["card"] == 1.0
    assert pii.find("facture 4111111111111111")[0][3] < 0.9
