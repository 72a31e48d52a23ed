"""A corpus pipeline over ``documents``: five stages, each one operator of ``shelfmark.llm``.

1. ``language_id``: texts without a language (no letters, or none with 40 % of the letters, those of
   scripts that no language uses included) go.
2. ``exact_dedup``: of equal texts the row with the largest doc_id stays.
3. ``near_dedup``: of each class of near-duplicates its representative stays.
4. ``mix``: sources are mixed to their target weights; documents may be there twice, always whole:
   the one at which a source's budget ends is taken or left, whichever is nearer the target.
5. ``pack``: the mix is tokenised and packed into sequences of at most 2048 tokens.

Each stage's result is written as Parquet to the session's shared folder and read by the next.

Defined cases, for every stage: null and empty texts (only the last two stages can meet them, as the first drops them; they have
no words and pack to one id); very long texts are handled whole; repeated rows are rows of their own until ``exact_dedup``
keeps one; an empty table gives an empty result; other columns, whatever their names, are carried along, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import exact_dedup, langid, mixing, near_dedup, packing
from shelfmark.llm.common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text has a language; the model is learned from these documents. Ties between languages go to the first by name."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id (of several such rows, one)."""
    return exact_dedup.keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates (0.8 of word 5-shingles or more), its representative; a tie in similarity joins as well."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, whole; draws are by hash, so reruns agree. ``n_chars`` is the text's."""
    return mixing.mixed_rows(docs, whole=True).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 tokens and its place in a sequence; ties between sequences go to the lowest number."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack),
]

#: SQL cannot express ProbMinHash classes or tokenisation; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
