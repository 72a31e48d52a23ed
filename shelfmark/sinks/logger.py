"""Driver-side logger: threshold, console, file, buffer, and the buffer as a table."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.logs import PRIORITY
from shelfmark.sinks.console import CYAN, GRAY, RED, RESET, YELLOW
from shelfmark.sinks.files import write_text

COLOURS = {"debug": GRAY, "info": CYAN, "warn": YELLOW, "error": RED}


@dataclass(frozen=True)
class LogEntry:
    timestamp: str
    level: str
    message: str
    details: Any = None


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class Logger:
    def __init__(self, level: str = "info", log_file: str | None = None, colour: bool = True):
        self.level, self.log_file, self.colour = level, log_file, colour
        self._entries: list[LogEntry] = []
        if log_file:
            write_text(log_file, "", append=True)

    def should_log(self, level: str) -> bool:
        """An unknown configured level lets nothing through."""
        return self.level in PRIORITY and PRIORITY[level] >= PRIORITY[self.level]

    def log(self, level: str, message: str, details: Any = None) -> None:
        if not self.should_log(level):
            return
        entry = LogEntry(now(), level, message, details)
        self._entries.append(entry)
        prefix = f"[{level.upper()}]"
        print(f"{COLOURS[level]}{prefix}{RESET} {message}" if self.colour else f"{prefix} {message}")
        if details:
            print(json.dumps(details, indent=2, ensure_ascii=False, default=str))
        if self.log_file:
            shown = " " + json.dumps(details, ensure_ascii=False, separators=(",", ":"), default=str) if details else ""
            write_text(self.log_file, f"{entry.timestamp} [{level.upper()}] {message}{shown}\n", append=True)

    def debug(self, message: str, details: Any = None) -> None:
        self.log("debug", message, details)

    def info(self, message: str, details: Any = None) -> None:
        self.log("info", message, details)

    def warn(self, message: str, details: Any = None) -> None:
        self.log("warn", message, details)

    def error(self, message: str, details: Any = None) -> None:
        self.log("error", message, details)

    def entries(self) -> list[LogEntry]:
        return list(self._entries)

    def clear(self) -> None:
        self._entries.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        """(timestamp, level, message, details VARIANT)."""
        rows = [(e.timestamp, e.level, e.message, None if e.details is None else json.dumps(e.details, default=str)) for e in self._entries]
        return spark.createDataFrame(rows, "timestamp string, level string, message string, details string").withColumn("details", F.parse_json("details"))
