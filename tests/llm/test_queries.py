"""The registered queries on the smallest tables, against SQL or brute force; columns of any name."""

import base64
import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import exact_dedup, langid, mixing, mpeg_audio, near_dedup, packing, pii, registry, repeats, sharding, warc
from tests.llm.test_native import brute_targets
from tests.llm.test_texts import base_spans, brute_repeats, brute_similarity, shingles_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def rows_of(spark, name, expected):
    """The query's rows; its columns start with the expected ones."""
    df = registry.queries()[name](spark, SF)
    assert df.dtypes[: len(expected)] == list(expected.items())
    return df.collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel, df = con.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert collections.Counter(map(tuple, df.select(*cols).collect())) == collections.Counter(rel.project(", ".join(cols)).fetchall())


def test_op1(spark, table):
    rows = rows_of(spark, "op1_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in table}
    own, source = collections.Counter(), {r["doc_id"]: r["source"] for r in table}
    for i, n in size.items():
        own[source[i]] += n
    target, taken = brute_targets(own), collections.Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == own[source[r.doc_id]] and 0 <= r.taken <= 2 * r["size"]
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(table) and all(abs(taken[s] - target[s]) < 1 for s in own)


def test_op2(spark, table):
    expected = {"doc_id": "bigint"} | {f"n_{k}": "bigint" for k in pii.BASE} | {"base_sha256": "string", "spans": "string"}
    got = {r.doc_id: r for r in rows_of(spark, "op2_pii", expected)}
    assert len(got) == len(table)
    for r in table:
        own, row = base_spans(r["text"] or ""), got[r["doc_id"]]
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in own) for k in pii.BASE]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        spans = [s.split(":") for s in row.spans.split(",")] if row.spans else []
        assert [s for s in spans if s[0] in pii.BASE] == [[k, str(a), str(b)] for k, a, b in own]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))


def test_op3(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    columns = {"doc_id": "bigint", "piece": "int"} | dict.fromkeys(("start", "length", "ids_crc32", "sequence_id", "offset"), "bigint")
    rows, encoder = rows_of(spark, "op3_packing", columns), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for r, e in zip(table, encoder.encode_batch([r["text"] or "" for r in table], add_special_tokens=False), strict=True):
        ids, at = np.array([*e.ids, 0], "<u4"), 0
        for k, piece in enumerate(sorted(by_doc[r["doc_id"]], key=lambda p: p.piece)):
            assert (piece.piece, piece.start, piece.ids_crc32) == (k, at, zlib.crc32(ids[at : at + piece.length].tobytes()))
            at += piece.length
        assert at == len(ids) and (len(ids) > 2048 or len(by_doc[r["doc_id"]]) == 1)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048


def brute_scores(model, text):
    """(scores, letters) of the words of a text, n-gram by n-gram."""
    words, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    out = []
    for w in words:
        total = sum(model.weights[model.index.get(g, 0)].astype(float) for g in langid.grams(w.lower()))
        total = total + model.scripts[langid.script(w[0])] if langid.script(w[0]) in model.scripts else total * 0
        out.append(np.maximum(total - total.max(), -langid.SPREAD))
    return np.array(out).reshape(-1, len(model.langs)), [len(w) for w in words]


def test_op5(spark, table):
    rows = rows_of(spark, "op5_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    lang = {r["doc_id"]: r["lang"] for r in table}
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert len(rows) == len(table) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_model_by_brute_force(spark, table):
    """Counts, scores and labels against plain loops; dense and searched tables agree."""
    part = [r for r in table if r["text"] and r["lang"]][:40]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in part], "doc_id bigint, text string, lang string")
    model = langid.train(frame)
    counts = collections.defaultdict(collections.Counter)
    for r in part:
        for w in "".join(c if c.isalpha() else " " for c in r["text"]).split():
            counts[r["lang"]].update(langid.grams(w.lower()))
    assert set(model.index) == {g for c in counts.values() for g in c} and model.langs == sorted(counts)
    for i, name in enumerate(model.langs):
        total = sum(counts[name].values()) + 0.5 * len(model.weights)
        for g in list(model.index)[::17]:
            assert abs(model.weights[model.index[g], i] - np.log((counts[name][g] + 0.5) / total)) < 1e-4
    texts = [r["text"] for r in table[40:60]] + ["Ünïcode ĀĂ Привет x1y 你好 ², a", "", "zz"]
    for scorer in (langid.Scorer(model), langid.Scorer(model, dense=0)):
        for t in texts:
            scores, _, letters, _ = scorer(t)
            expected, lengths = brute_scores(model, t)
            assert letters.tolist() == lengths and np.allclose(scores, expected, atol=2e-3)
    rng = np.random.default_rng(1)
    for _ in range(30):  # long texts in blocks give the labels of one pass
        lengths = rng.integers(0, 60, 4)
        scores = -rng.random((lengths.sum(), 3)) * 6
        assert langid.viterbi(scores, lengths, 3.0, 5).tolist() == langid.viterbi(scores, lengths, 3.0, 1000).tolist()


@pytest.mark.parametrize("rows", [[(1, None)], [(1, "")], [(1, "123 !?"), (None, None)]])
def test_language_without_words(spark, rows):
    """Partitions that hold no word at all."""
    model = langid.Model(["de", "en"], {"a": 1}, np.zeros((2, 2), np.float32), {"latin": np.zeros(2)})
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string").coalesce(1)
    assert {(r.lang_pred, r.score, len(r.spans)) for r in langid.identify(frame, model).collect()} == {("und", 0.0, 0)}
    assert langid.keep_identified(frame).count() == 0


def test_rows_of_one_identifier_keep_their_language(spark):
    rows = [(None, f"der Hund und die Katze {chr(97 + i % 26) * 3}", "de") for i in range(60)] + [(i, f"the dog {chr(97 + i % 26) * 4}", "en") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_lang=5)
    assert model.langs == ["de", "en"]


def test_op7(spark, table):
    rows = registry.queries()["op7_sharding"](spark, SF).collect()
    size, shards = {r["doc_id"]: len((r["text"] or "").encode()) for r in table}, collections.Counter()
    for r in rows:
        assert r.n_bytes == size[r.doc_id]
        shards[r.shard] += r.n_bytes
    assert len(rows) == len(table) and all(r.shard_bytes == shards[r.shard] <= sharding.SHARD_BYTES for r in rows)


def test_op8_recall(spark, table):
    """Classes are those of all pairs that share a shingle."""
    rows = {r.doc_id: r for r in registry.queries()["op8_near_dedup"](spark, SF).collect()}
    sets, having = {r["doc_id"]: shingles_of(r["text"]) for r in table}, collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    pairs = {(a, b) for ids in having.values() for a in ids for b in ids if a < b}
    near = [(a, b) for a, b in pairs if brute_similarity(sets[a], sets[b]) >= 0.8]
    found = sum(rows[a].class_id == rows[b].class_id for a, b in near)
    assert near and found >= 0.99 * len(near)
    for r in rows.values():
        if r.class_id != r.doc_id:
            assert any(r.doc_id in p for p in near)


def test_op9(spark, table):
    columns = {
        "doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint",
        "media_sha256": "string", "feature": "string",
    }
    got = {r.doc_id: r for r in rows_of(spark, "op9_mpeg_audio", columns)}
    for r in table:
        raw, row = (r["text"] or "").encode(), got[r["doc_id"]]
        padded, media = raw + b"\0" * (-len(raw) % 64 if raw else 64), mpeg_audio.store(mpeg_audio.payload_of(r["text"])[1])
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert row.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert (row.media_bytes, row.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def plain_frames(data):
    """An independent reading of 48 kHz stereo layer III frames: (offset, body) after the tag."""
    kbit = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    at, out = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]), []
    while data[at : at + 3] != b"TAG":
        assert data[at] == 0xFF and data[at + 1] | 1 == 0xFB and data[at + 2] & 15 == 4
        size = 144 * kbit[data[at + 2] >> 4] // 48
        out.append((at, data[at + (4 if data[at + 1] & 1 else 6) + 32 : at + size]))
        at += size
    return out


def test_op9_against_another_reader():
    payload = bytes(range(256)) * 40
    data = mpeg_audio.store(payload)
    frames = plain_frames(data)
    assert frames[0][1][:4] == b"Xing" and b"".join(b for _, b in frames[1:])[: len(payload)] == payload
    assert mpeg_audio.probe(data).offsets == [at for at, _ in frames[1:]]


def test_op10(spark, table):
    columns = {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    got = collections.Counter(tuple(r) for r in rows_of(spark, "op10_repeats", columns))
    assert got == collections.Counter(x[:5] for x in brute_repeats([(r["doc_id"], r["text"]) for r in table]).elements())


NAMES = ("_metadata", "__file", "a.b", "file", "row", "key", "size", "all", "id", "__all", "taken", "source_size", "h1", "lang_pred", "payload", "rid")


def test_columns_of_any_name(spark, tmp_path):
    rows = [
        (i, t, "en" if i % 2 else "fr", "s", len(t or ""), *range(len(NAMES)))
        for i, t in enumerate(["the dog and the cat", "le chien et le chat", "the dog and the cat", None, "", "the only one " * 30, "le seul " * 30])
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` int" for n in NAMES)
    frame = spark.createDataFrame(rows, schema)
    frame.write.parquet(str(tmp_path / "docs"))
    for docs in (frame, spark.read.parquet(str(tmp_path / "docs"))):
        for keep in (langid.keep_identified, exact_dedup.keep_unique, near_dedup.keep_one, mixing.mixed_rows):
            out = keep(docs)
            assert out.columns == docs.columns and 4 <= out.count() <= 14
            assert {tuple(r[5:]) for r in out.collect()} == {tuple(range(len(NAMES)))}
        model = langid.train(docs)
        pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("source").alias("url"), *[F.col(f"`{n}`") for n in NAMES])
        warc.write_archives(pages, path := str(tmp_path / f"warc{docs is frame}"))
        assert warc.read_archives(spark, path).where("is_last").count() == len(rows)
        for made in (
            exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs), langid.identify(docs, model), mixing.mix(docs), pii.pii_spans(docs),
            sharding.shard(docs, 100), mpeg_audio.probe_media(mpeg_audio.store_texts(docs)), repeats.repeated(docs), packing.pack(docs),
        ):
            assert made.count() == len(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns, name


@pytest.mark.parametrize("form", ["json", "orc", "csv"])
def test_tables_of_any_form(spark, tmp_path, form):
    """Only Parquet rows have an index; other tables are staged first."""
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in enumerate(["the dog and the cat", "le chien et le chat", "the dog and the cat", "the only one " * 30, "le seul " * 30])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.format(form).save(str(tmp_path / "docs"))
    docs = spark.read.format(form).schema(schema).load(str(tmp_path / "docs"))
    for made in (sharding.shard(docs, 100), repeats.repeated(docs), mpeg_audio.store_texts(docs)):
        assert made.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 4, name


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 1_200_000, " \n" * 600_000])
def test_long_runs_of_white_space(spark, tmp_path, run):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [f"before{run}after", run, f"{run}x <|endoftext|>"]
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.queries()["op3_packing"](spark, str(tmp_path)).collect()
    for i, e in enumerate(ids):
        own, at = np.array([*e.ids, 0], "<u4"), 0
        for piece in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece):
            assert piece.ids_crc32 == zlib.crc32(own[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(own)
    assert corpus_pipeline.pack(spark, docs, "").count() == len(rows)


def test_warc_identifiers_of_any_characters(spark, tmp_path):
    ids = ["a\r\nWARC-Type: x", " outer spaces ", "ünï+code%20", "\r\n\r\n", "plain", "", None]
    pages = spark.createDataFrame([(i, "u", h) for i in ids for h in ("same", f"own {i}")], "page_id string, url string, html string")
    warc.write_archives(pages, str(tmp_path / "warc"))
    rows = warc.read_archives(spark, str(tmp_path / "warc")).where("is_last").collect()
    assert collections.Counter(r.page_id for r in rows) == collections.Counter(ids * 2)
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {""} and sum(r.record_type == "revisit" for r in rows) == len(ids) - 1


def test_empty_pipeline(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    """Texts longer than any portion, in every operator that reads texts."""
    long = "several words that go on and on, until no portion holds them all " * 60_000
    rows = [(1, long, "en", "a"), (2, long + "end", "en", "b"), (3, "short text here", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id: r.taken <= 2 * r["size"] for r in mixing.mix(docs).collect()} == {1: True, 2: True, 3: True}
    assert {r.class_id for r in near_dedup.near_dedup(docs).collect()} == {1, 3}
    assert sorted(r.n_bytes for r in sharding.shard(docs, 1 << 20).collect()) == sorted(len(t.encode()) for _, t, _, _ in rows)
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()} == {"en"}
    assert base64.b32encode(b"") == b""
