"""JSON files of any size as rows: (file, pointer, part, kind, value), and errors with their byte offset.

A task reads its files in portions and holds the portion, the path to the present value and the present scalar; a string of
over ``PIECE`` bytes comes in several rows (``part`` 0, 1, ...), so a document needs no memory of its size.  Objects and arrays have no row of their own unless
they are empty.  Pointers are those of RFC 6901.  A broken document gives the rows before the break, and then one of kind ``error`` with the message
and the offset; a file that can't be read gives an error at offset 0.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at once, and of a string that make a row.
PORTION, PIECE = 1 << 20, 1 << 20

SPACE = re.compile(rb"[ \t\n\r]*")
SCALAR = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
WORD = re.compile(rb"[-+.0-9A-Za-z]*")
#: What a string may hold; a pair of surrogates is one unit.
UNITS = re.compile(rb'(?:[^"\\\x00-\x1f]|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\["\\/bfnrt])*+')
HIGH, LOW = re.compile(rb"\\u[dD][89abAB][0-9a-fA-F]{2}"), re.compile(rb"\\u[dD][c-fC-F][0-9a-fA-F]{2}")
#: The longest unit of a string less one, in bytes, a character's bytes included.
HOLD = 11


class Broken(ValueError):
    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.offset = offset


class Parser:
    """Parses portions of one document; yields (pointer, part, kind, value)."""

    def __init__(self, source: Iterator[bytes], piece: int = PIECE):
        self.source, self.piece = source, piece
        self.data, self.at, self.before, self.ended = b"", 0, 0, False

    def broken(self, message: str, at: int | None = None) -> Broken:
        return Broken(message, self.before + (self.at if at is None else at))

    def more(self) -> bool:
        """Read on; what has been used goes."""
        chunk = b"" if self.ended else next(self.source, b"")
        if not chunk:
            self.ended = True
            return False
        self.before += self.at
        self.data, self.at = self.data[self.at :] + chunk, 0
        return True

    def peek(self) -> bytes:
        """The next byte that is no white space; empty at the end."""
        while True:
            self.at = SPACE.match(self.data, self.at).end()
            if self.at < len(self.data):
                return self.data[self.at : self.at + 1]
            if not self.more():
                return b""

    def text(self) -> Iterator[str]:
        """The string at this place, in pieces."""
        self.at += 1
        size = 0
        while True:
            end = UNITS.match(self.data, self.at).end()
            if self.data[end : end + 1] == b'"':
                yield self.decoded(end)
                self.at = end + 1
                return
            if self.ended or len(self.data) - end > HOLD:
                raise self.broken("string does not end" if end >= len(self.data) else "bad character in string", end)
            size = end - self.at
            if size > self.piece + 2 * HOLD:
                end = UNITS.match(self.data, self.at, end - HOLD).end()  # a pair of surrogates or a character may go on
                while end > self.at and (self.data[end] & 0xC0) == 0x80:
                    end -= 1
                if LOW.match(self.data, end) and HIGH.match(self.data, end - 6, end) and UNITS.match(self.data, self.at, end - 6).end() == end - 6:
                    end -= 6  # the pair that would be cut goes on whole
                yield self.decoded(end)
                self.at = end
            self.more()

    def decoded(self, end: int) -> str:
        raw = self.data[self.at : end]
        try:
            text = raw.decode()
        except UnicodeDecodeError as error:
            raise self.broken("text is not UTF-8", self.at + error.start) from None
        return json.loads(f'"{text}"').encode("utf-8", "replace").decode() if "\\" in text else text

    def scalar(self) -> tuple[str, str]:
        while True:
            end = WORD.match(self.data, self.at).end()
            if end < len(self.data) or not self.more():
                break
        word = self.data[self.at : end]
        if not SCALAR.fullmatch(word):
            raise self.broken(f"unexpected {'end of input' if self.at >= len(self.data) else repr(self.data[self.at : max(end, self.at + 1)][:20].decode('latin-1'))}")
        self.at = end
        kind = "null" if word == b"null" else "boolean" if word in (b"true", b"false") else "number"
        return kind, word.decode()

    def values(self) -> Iterator[tuple[str, int, str, str | None]]:
        # the open objects and arrays, each with its key or index
        path: list[str | int] = []
        arrays: list[bool] = []
        expecting = "value"
        while True:
            c = self.peek()
            if expecting == "value":
                if c in (b"{", b"["):
                    self.at += 1
                    closing = b"}" if c == b"{" else b"]"
                    if self.peek() == closing:
                        self.at += 1
                        yield pointer(path), 0, "object" if c == b"{" else "array", None
                    else:
                        arrays.append(c == b"[")
                        path.append(0 if c == b"[" else "")
                        expecting = "value" if c == b"[" else "key"
                        continue
                elif c == b'"':
                    own = pointer(path)
                    for part, piece in enumerate(self.text()):
                        yield own, part, "string", piece
                else:
                    kind, word = self.scalar()
                    yield pointer(path), 0, kind, None if kind == "null" else word
                expecting = "next"
            elif expecting == "key":
                if c != b'"':
                    raise self.broken("a key was expected")
                path[-1] = "".join(self.text())
                if self.peek() != b":":
                    raise self.broken("a colon was expected")
                self.at += 1
                expecting = "value"
            elif not path:
                if c:
                    raise self.broken("text after the document's end")
                return
            elif c == b",":
                self.at += 1
                expecting = "value" if arrays[-1] else "key"
                if arrays[-1]:
                    path[-1] += 1
            elif c == (b"]" if arrays[-1] else b"}"):
                self.at += 1
                path.pop()
                arrays.pop()
            else:
                raise self.broken(f"a comma or {']' if arrays[-1] else '}'} was expected")


def pointer(path: list[str | int]) -> str:
    return "".join(f"/{str(p).replace('~', '~0').replace('/', '~1')}" for p in path)


SCHEMA = "file string, pointer string, part int, kind string, value string, offset bigint"
FIELDS = [("file", pa.string()), ("pointer", pa.string()), ("part", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("offset", pa.int64())]


def portions(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with files.open_input_stream(name) as f:
        while chunk := f.read(PORTION):
            yield chunk


def parsed(file: str, piece: int = PIECE) -> Iterator[tuple]:
    """The rows of one file."""
    try:
        yield from ((file, *row, None) for row in Parser(portions(file), piece).values())
    except Broken as error:
        yield file, None, None, "error", str(error), error.offset
    except OSError as error:
        yield file, None, None, "error", str(error), 0


def read_json(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The rows of the files named in a column ``file`` (paths or URIs that the executors can open): see SCHEMA."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], names=[n for n, _ in FIELDS])

        for batch in batches:
            for file in batch.column(0).to_pylist():
                for row in parsed(file):
                    rows.append(row)
                    size += 100 + len(row[4] or "")
                    if size > PORTION:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return files.select("file").mapInArrow(run, SCHEMA)


def errors(rows: DataFrame) -> DataFrame:
    """What was wrong: file, offset, message."""
    return rows.where("kind = 'error'").select("file", "offset", F.col("value").alias("message"))
