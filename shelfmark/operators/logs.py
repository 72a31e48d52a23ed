"""Log tables: level threshold and line format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priorities of levels.
PRIORITY = {"debug": 0, "info": 1, "warn": 2, "error": 3}


def priority(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[level]


def at_threshold(logs: DataFrame, configured: str) -> DataFrame:
    """Entries at or above a level; an unknown level lets nothing through."""
    if configured not in PRIORITY:
        return logs.where(F.lit(False))
    return logs.where(priority(F.col("level")) >= PRIORITY[configured])


def line(timestamp: Column, level: Column, message: Column, details: Column | None = None) -> Column:
    """``<timestamp> [LEVEL] <message>``, then the details as JSON unless they are null, 0, '' or false."""
    head = F.concat(timestamp, F.lit(" ["), F.upper(level), F.lit("] "), message)
    if details is None:
        return head
    shown = ~F.coalesce(details, F.lit("null")).isin("null", "0", "-0", "0.0", '""', "false")
    return F.concat(head, F.when(shown, F.concat(F.lit(" "), details)).otherwise(""))
