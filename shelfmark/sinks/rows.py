"""Text sinks: CSV (own dialect), table and JSON rows as string columns, and as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.sinks.documents import Document
from shelfmark.sinks.lines import write_lines

COMPLEX = (T.StructType, T.ArrayType, T.MapType)


def csv_value(value: Column, kind: T.DataType) -> Column:
    """Null is empty, nested values are JSON; only values with a comma are quoted."""
    text = F.to_json(value) if isinstance(kind, COMPLEX) else value.cast("string")
    text = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.contains(","), quoted).otherwise(text)


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def csv_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Column ``line`` (besides those to keep); the header is ``csv_header``."""
    fields = [f for f in df.schema.fields if f.name not in keep]
    return df.select(*keep, F.concat_ws(",", *[csv_value(F.col(f"`{f.name}`"), f.dataType) for f in fields]).alias("line"))


def table_rows(value: Column) -> Column:
    return F.concat(F.lit("- "), F.coalesce(value.cast("string"), F.lit("null")))


def json_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Column ``line``: compact JSON without null fields."""
    fields = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields])).alias("line"))


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """CSV files with one header; without rows there is none.  Files concatenated in their order are sorted by ``order``."""
    rows = csv_rows(df.orderBy(*order) if order else df)
    write_lines(rows, path, csv_header(df), "csv", mode)


def write_table(df: DataFrame, column: str, path: str, order: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """A list item per row."""
    write_lines((df.orderBy(*order) if order else df).select(table_rows(F.col(f"`{column}`")).alias("line")), path, suffix="txt", mode=mode)


def json_array(df: DataFrame, order: tuple[str, ...], indent: str = "") -> Document:
    """All rows as one JSON array; compact, or with a row a line."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return Document(df.select(*order, text.alias("block")), order, f"[{indent}", f",{indent}", f"{indent}]")


def append_text(lines: DataFrame, path: str) -> None:
    """Append one string column (log lines) to a folder of text files; each append counts once."""
    write_lines(lines, path, suffix="log")
