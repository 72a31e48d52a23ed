"""Console: messages, and data as JSON, CSV or table.  Runs on the driver."""

from __future__ import annotations

import json
import sys
from collections.abc import Mapping
from typing import Any, TextIO

GREEN, YELLOW, RED, CYAN, GRAY, BOLD, RESET = "\x1b[32m", "\x1b[33m", "\x1b[31m", "\x1b[36m", "\x1b[90m", "\x1b[1m", "\x1b[0m"


def text_of(value: Any) -> str:
    """A value as ECMAScript's String() shows it, as far as JSON values go."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, (list, tuple)):
        return ",".join("" if v is None else text_of(v) for v in value)
    return "[object Object]" if isinstance(value, Mapping) else str(value)


def json_text(value: Any, indent: int = 0) -> str:
    if indent:
        return json.dumps(value, indent=indent, ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Console:
    def __init__(self, out: TextIO | None = None, colour: bool = True):
        self.out, self.colour = out, colour

    def write(self, message: str) -> None:
        print(message, file=self.out or sys.stdout)

    def _in(self, code: str, message: str) -> None:
        self.write(f"{code}{message}{RESET}" if self.colour else message)

    def success(self, message: str) -> None:
        self._in(GREEN, message)

    def info(self, message: str) -> None:
        self.write(message)

    def warning(self, message: str) -> None:
        self._in(YELLOW, message)

    def error(self, message: str) -> None:
        self._in(RED, message)

    def newline(self) -> None:
        self.write("")

    def section(self, title: str) -> None:
        self._in(BOLD, title)

    def key_value(self, key: str, value: Any) -> None:
        self.write(f"{key}: {text_of(value)}")

    def csv(self, data: Any) -> None:
        if not isinstance(data, list):
            self.write(text_of(data))
            return
        if not data:
            return
        if not isinstance(data[0], Mapping):
            for item in data:
                self.write(text_of(item))
            return
        headers = list(data[0])
        self.write(",".join(headers))
        for item in data:
            if isinstance(item, Mapping):
                self.write(",".join(self._field(item.get(h)) for h in headers))

    @staticmethod
    def _field(value: Any) -> str:
        if value is None:
            return ""
        text = json_text(value) if isinstance(value, (Mapping, list)) else text_of(value)
        return '"' + text.replace('"', '""') + '"' if "," in text else text

    def table(self, data: Any) -> None:
        for item in data if isinstance(data, list) else []:
            self.write(f"- {text_of(item)}")
        if not isinstance(data, list):
            self.write(text_of(data))

    def formatted(self, data: Any, kind: str) -> None:
        {"json": lambda d: self.write(json_text(d, 2)), "csv": self.csv, "table": self.table}.get(kind, lambda d: self.write(text_of(d)))(data)
