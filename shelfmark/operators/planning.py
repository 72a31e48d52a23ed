"""Planning moves and renames: one projection and one filter, no shuffle.

``type`` says "move" whenever a file has a target folder, also if its directory stays the same;
files without one are renamed in place.  Operations that change nothing are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.config import Config
from shelfmark.functions.naming import apply_convention
from shelfmark.functions.paths import clean, is_clean, join

MOVE, RENAME, MOVE_RENAME = "move", "rename", "move-rename"
TYPES = (MOVE, RENAME, MOVE_RENAME)


def target_dir(config: Config, base: str) -> Column:
    root = clean(config.target_directory or base).rstrip("/")
    folder = F.col("target_folder")
    return F.when(folder != "", F.concat(F.lit(root + "/"), folder)).otherwise(F.col("__home"))


def new_path(folder: Column, name: Column, canonical: bool) -> Column:
    """``join`` of both.  With canonical folders only an empty name or ``.`` is special, and the
    expression stays within generated code."""
    if not canonical:
        return join(folder, name)
    return F.when(name.isin("", "."), folder).otherwise(F.concat(folder, F.lit("/"), name))


def operation_type(moves: Column, renames: Column) -> Column:
    return F.when(moves & renames, MOVE_RENAME).when(moves, MOVE).otherwise(RENAME)


def reason(moves: Column, renames: Column, folder: Column, name: Column) -> Column:
    both = F.concat(F.lit("Moving to "), folder, F.lit(" and renaming to "), name)
    return F.when(moves & renames, both).when(moves, F.concat(F.lit("Moving to "), folder)).otherwise(F.concat(F.lit("Renaming to "), name))


def plan_operations(files: DataFrame, config: Config, base: str) -> DataFrame:
    """files (scan_index, original_path, filename, target_folder) -> operations
    (scan_index, type, original_path, new_path, reason).

    Original paths are absolute and normalised, as a scan gives them.
    """
    canonical = all(is_clean(r.target_folder or "x") for r in config.categories)
    home = F.regexp_replace(F.col("original_path"), "/[^/]*$", "")
    named = files.withColumns({"__name": apply_convention(F.col("filename"), config.naming_convention), "__home": home})
    named = named.withColumn("__dir", target_dir(config, base))
    named = named.withColumn("new_path", new_path(F.col("__dir"), F.col("__name"), canonical))
    moves, renames = F.col("target_folder").isNotNull(), F.col("filename") != F.col("__name")
    return named.where(F.col("new_path") != F.col("original_path")).select(
        "scan_index", operation_type(moves, renames).alias("type"), "original_path", "new_path",
        reason(moves, renames, F.col("target_folder"), F.col("__name")).alias("reason"),
    )


def with_suggestions(files: DataFrame, config: Config) -> DataFrame:
    """Fill ``needs_rename`` and ``suggested_name``."""
    name = apply_convention(F.col("filename"), config.naming_convention)
    return files.withColumns({"suggested_name": name, "needs_rename": F.col("filename") != name})
