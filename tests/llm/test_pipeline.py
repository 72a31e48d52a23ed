"""The pipeline against a brute-force version of its stages on a small table."""

import collections
import itertools
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import mixing, packing
from shelfmark.llm.near_dedup import THRESHOLD
from tests.llm.test_texts import best_fit_decreasing, brute_similarity, shingles_of


def test_pipeline(spark, tmp_path):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:60]
    base = table[0]
    table += [base | {"doc_id": 1000}, base | {"doc_id": 1001, "text": base["text"] + " one more"}, base | {"doc_id": 1002, "text": None}]
    table += [base | {"doc_id": 1003, "text": "12 34"}, table[5] | {"doc_id": 1004, "source": None}]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame([tuple(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")) for r in table], schema)
    frame.write.parquet(str(tmp_path / "documents.parquet"))

    docs, stages = frame.sparkSession.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stages[name] = docs.collect()

    kept = {r.doc_id: r.text for r in stages["language_id"]}
    assert {r["doc_id"] for r in table} - set(kept) == {1002, 1003}  # all clean texts stay
    last = {t: max(i for i, x in kept.items() if x == t) for t in kept.values()}
    assert sorted(r.doc_id for r in stages["exact_dedup"]) == sorted(last.values())
    rest = {i: kept[i] for i in last.values()}
    sets, best = {i: shingles_of(t) for i, t in rest.items()}, {i: i for i in rest}
    for a, b in itertools.combinations(sorted(rest), 2):
        if set(sets[a]) & set(sets[b]) and brute_similarity(sets[a], sets[b]) >= THRESHOLD and best[a] != best[b]:
            low, high = sorted((best[a], best[b]))
            best = {i: low if c == high else c for i, c in best.items()}
    assert sorted(r.doc_id for r in stages["near_dedup"]) == sorted(set(best.values()))
    words, mixed = {r.doc_id: len(r.text.split()) for r in stages["near_dedup"]}, collections.Counter()
    for r in stages["mix"]:
        assert rest[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        mixed[r.doc_id] += len(r.text.split())
    assert all(n <= 2 * words[i] for i, n in mixed.items())
    assert math.isclose(sum(mixed.values()), 1.5 * sum(words.values()), rel_tol=0.02)
    encode, pieces = packing.encoder(packing.byte_bpe_50k()).encode_ordinary, collections.Counter()
    for r in stages["mix"]:
        ids = np.array([*encode(r.text), 0], "<u4")
        for a, b in packing.cut(len(ids), 2048):
            pieces[r.doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages["pack"]) == pieces
    assert len({r.sequence_id for r in stages["pack"]}) == best_fit_decreasing([r.length for r in stages["pack"]], 2048)
    again = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset", "piece")
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in stages["pack"]
    )
    assert mixing.WEIGHTS == (3, 1, 2) and docs.where(F.col("length") > 2048).count() == 0


def test_mix_keeps_documents_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in corpus_pipeline.mix(spark, docs, "").collect())
