"""Classification and planning of a stream of paths.

Both are projections and filters, so they hold for streaming DataFrames as they are; rows
carry their own ``scan_index``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.config import Config
from shelfmark.functions.paths import clean, join
from shelfmark.operators.classify import classify, with_names
from shelfmark.operators.planning import plan_operations
from shelfmark.sources.inventory import visible


def plan_stream(paths: DataFrame, config: Config, base: str) -> DataFrame:
    """(scan_index, rel_path) -> operations."""
    files = classify(with_names(visible(paths, config)), config.categories)
    return plan_operations(files.withColumn("original_path", join(clean(base), F.col("rel_path"))), config, base)
