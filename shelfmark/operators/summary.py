"""Counts: categories, operation types, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.planning import TYPES

UNCATEGORIZED = "uncategorized"


def category_label(category: Column) -> Column:
    return F.coalesce(F.nullif(category, F.lit("")), F.lit(UNCATEGORIZED))


def category_summary(files: DataFrame) -> DataFrame:
    """(category, n, first_index): order by ``first_index`` for first-seen order."""
    return files.groupBy(category_label(F.col("category")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.min("scan_index").alias("first_index")
    )


def operation_type_counts(operations: DataFrame) -> DataFrame:
    """(type, n) for all three types, zero if a type has none."""
    counts = [F.count_if(F.col("type") == t).alias(t) for t in TYPES]
    rows = F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"`{t}`").alias("n")) for t in TYPES])
    return operations.agg(*counts).select(F.inline(rows))


def outcome_counts(results: DataFrame) -> DataFrame:
    """(total, successful, failed) in one row."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def errors(results: DataFrame) -> DataFrame:
    """(error_index, file, error) of failed operations; order by ``error_index``."""
    return results.where("status = 'failed'").select(F.col("scan_index").alias("error_index"), F.col("original_path").alias("file"), "error")
