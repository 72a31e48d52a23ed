"""Manifests: operations joined with their first error, as rows and as documents (JSON, Markdown).

A document's blocks are one per entry (``sinks.documents``), so manifests of any length are written by tasks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.sinks.documents import Document
from shelfmark.tables import staged

TITLE = "File Organization Manifest"


def entries(operations: DataFrame, errors: DataFrame, timestamp: Column) -> DataFrame:
    """One row per operation: scan_index, timestamp, operation, status, error.

    errors: (error_index, file, error); the first one of a file counts.
    """
    first = errors.groupBy(F.col("file").alias("original_path")).agg(F.min_by("error", "error_index").alias("error"))
    met = operations.drop("status", "error").join(first, "original_path", "left")
    operation = F.struct("type", "original_path", "new_path", "reason")
    return met.select(
        "scan_index", timestamp.alias("timestamp"), operation.alias("operation"),
        F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error",
    )


def iso(timestamp: Column) -> Column:
    """ISO-8601 with milliseconds, for a UTC session."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSX")


@dataclass(frozen=True)
class Manifest:
    """Staged entries under a header."""

    entries: DataFrame
    generated_at: str
    total_operations: int
    successful: int
    failed: int


def header(entry_rows: DataFrame, successful: int, failed: int, timestamp: str) -> DataFrame:
    """One row: generated_at, total_operations, successful, failed.  The counts are the caller's, as are the
    errors behind the entries."""
    return entry_rows.agg(F.count(F.lit(1)).alias("total_operations")).select(
        F.lit(timestamp).alias("generated_at"), "total_operations", F.lit(successful).cast("long").alias("successful"), F.lit(failed).cast("long").alias("failed")
    )


def manifest(entry_rows: DataFrame, successful: int, failed: int, timestamp: str) -> Manifest:
    """The manifest of entries, which are evaluated once."""
    rows = staged(entry_rows, "entries")
    return Manifest(rows, **header(rows, successful, failed, timestamp).first().asDict())


def block(operation: Column, status: Column, error: Column) -> Column:
    """Markdown of one entry, with its final line break."""
    mark = F.when(status == "success", "✓").otherwise("✗")
    lines = [
        F.concat(F.lit("### "), mark, F.lit(" "), F.upper(operation["type"])),
        F.concat(F.lit("- **From:** `"), operation["original_path"], F.lit("`")),
        F.concat(F.lit("- **To:** `"), operation["new_path"], F.lit("`")),
        F.concat(F.lit("- **Reason:** "), operation["reason"]),
        F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("- **Error:** "), error)),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def markdown(document: Manifest, title: str = TITLE) -> Document:
    """The manifest as Markdown: a block per entry."""
    m = document
    head = f"# {title}\n\n**Generated:** {m.generated_at}\n\n**Total Operations:** {m.total_operations}\n**Successful:** {m.successful}\n**Failed:** {m.failed}\n"
    blocks = m.entries.select("scan_index", block(F.col("operation"), F.col("status"), F.col("error")).alias("block"))
    return Document(blocks, ("scan_index",), head + ("\n## Operations\n\n" if m.total_operations else ""), "\n")


def quoted(text: Column) -> Column:
    """A string as JSON."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


# Names in the JSON document.
_OPERATION = {"type": "type", "original_path": "originalPath", "new_path": "newPath", "reason": "reason"}


def json_block(timestamp: Column, operation: Column, status: Column, error: Column) -> Column:
    """One entry as indented JSON, without fields that are null."""

    def field(indent: int, name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f'{" " * indent}"{name}": '), quoted(value)))

    inner = F.concat_ws(",\n", *[field(8, name, operation[column]) for column, name in _OPERATION.items()])
    whole = F.concat(F.lit('      "operation": {\n'), inner, F.lit("\n      }"))
    return F.concat(F.lit("    {\n"), F.concat_ws(",\n", field(6, "timestamp", timestamp), whole, field(6, "status", status), field(6, "error", error)), F.lit("\n    }"))


def json_document(document: Manifest) -> Document:
    """The manifest as JSON with an indent of two spaces."""
    m = document
    fields = {"generatedAt": m.generated_at, "totalOperations": m.total_operations, "successful": m.successful, "failed": m.failed, "entries": []}
    text = json.dumps(fields, indent=2, ensure_ascii=False)
    blocks = m.entries.select("scan_index", json_block(*[F.col(c) for c in ("timestamp", "operation", "status", "error")]).alias("block"))
    if not m.total_operations:
        return Document(blocks, ("scan_index",), text)
    return Document(blocks, ("scan_index",), text.removesuffix("]\n}") + "\n", ",\n", "\n  ]\n}")
