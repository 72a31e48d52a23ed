"""Helpers for operators that work on Arrow batches: portions of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shelfmark.llm.common import staged

#: What a Python worker and its executor hold at once; Spark's own bound is 10,000 rows of any size.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def staged_in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """``staged`` for a DataFrame with Python stages over long texts."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in SMALL_BATCHES}
    for k, v in SMALL_BATCHES.items():
        conf.set(k, v)
    try:
        return staged(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def grouped(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``most``; an item is never split."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def portions(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, end, texts) of ranges of a string column with about ``most`` bytes each.

    Only a portion at a time becomes Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    for a, b in grouped(sizes, most):
        yield a, b, column.slice(a, b - a).to_pylist()
