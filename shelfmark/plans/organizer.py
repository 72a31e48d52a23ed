"""The façade: scan, plan, predict, execute, report."""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import Config
from shelfmark.operators import conflicts, execution, existence, manifest, planning, summary
from shelfmark.sinks.files import save_manifest, save_markdown
from shelfmark.sources import inventory
from shelfmark.tables import staged


class Organizer:
    def __init__(self, spark: SparkSession, config: Config, base: str, logger=None):
        self.spark, self.config, self.base, self.logger = spark, config, os.path.abspath(base), logger

    def scan(self) -> DataFrame:
        return inventory.scan(self.spark, self.base, self.config)

    def plan(self, files: DataFrame) -> DataFrame:
        return planning.plan_operations(files, self.config, self.base)

    def predict(self, operations: DataFrame) -> DataFrame:
        """What execution would give, from what is in the target folders now."""
        operations = staged(operations, "operations")
        return conflicts.resolve_conflicts(operations, existence.on_disk(operations), is_staged=True)

    def execute(self, operations: DataFrame) -> DataFrame:
        return execution.execute(operations, self.config.dry_run, logger=self.logger)

    def manifest(self, results: DataFrame, timestamp: str | None = None) -> manifest.Manifest:
        """The manifest of an execution; one timestamp for all entries."""
        at = timestamp or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        counts = summary.outcome_counts(results).first()
        rows = manifest.entries(results, summary.errors(results), F.lit(at))
        return manifest.manifest(rows, counts["successful"], counts["failed"], at)

    def save_manifests(self, document: manifest.Manifest, folder: str) -> None:
        save_manifest(document, os.path.join(folder, "manifest.json"))
        save_markdown(document, os.path.join(folder, "manifest.md"))
