"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from shelfmark.llm import alignment, conversations, exact_dedup, langid, mixing, mpeg_audio, near_dedup, packing, pii, repeats, sharding, toxicity, warc

MODULES = (mixing, pii, warc, langid, exact_dedup, sharding, mpeg_audio, packing, near_dedup, repeats, toxicity, conversations, alignment)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
