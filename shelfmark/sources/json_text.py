"""JSON text: parsing that gives null on failure, and files of it."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_parse(text: Column) -> Column:
    """VARIANT, null where the text is no JSON."""
    return F.try_parse_json(text)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, data (VARIANT, null where the file is no JSON)."""
    return read_texts(spark, path).select("path", safe_parse(F.col("value")).alias("data"))


def safe_parsed(rows: DataFrame, column: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``data``, the log of what isn't JSON, with columns to keep); null texts are not logged."""
    done = rows.withColumn("data", safe_parse(F.col(column)))
    bad = done.where(F.col("data").isNull() & F.col(column).isNotNull())
    return done, bad.select(*keep, F.lit("warn").alias("level"), F.lit("Failed to parse JSON string").alias("message"), F.left(F.col(column), F.lit(200)).alias("details"))


def parse_json(text: str, logger=None) -> Any | None:
    try:
        return json.loads(text)
    except ValueError as error:
        if logger:
            logger.warn("Failed to parse JSON string", {"error": str(error)})
        return None


def read_json_file(path: str, logger=None) -> Any | None:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as error:
        if logger:
            logger.error(f"Failed to parse JSON file: {path}", {"error": str(error)})
        return None


def write_json_file(path: str, data: Any, logger=None) -> bool:
    try:
        text = json.dumps(data, indent=2, ensure_ascii=False)
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return True
    except (OSError, TypeError, ValueError) as error:
        if logger:
            logger.error(f"Failed to write JSON file: {path}", {"error": str(error)})
        return False
