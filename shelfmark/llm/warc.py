"""WARC archives as tables of chunks.

Writing (DataFrame-native).  A page becomes one logical record; a payload above ``chunk_bytes``
is written as a segmented record (a ``response`` with ``WARC-Segment-Number: 1`` and
``continuation`` records), so no row holds more than one chunk of an archive.  Of pages with
equal payloads (length, SHA-1 and SHA-256 agree) the one with the smallest identifier is the
``response``; all others are ``revisit`` records that refer to it and carry no payload.  Spark's
text writer puts the records into ``part-*.txt.gz`` files of the folder given: every record ends
with CRLF CRLF, which is that writer's line separator, so the files are plain WARC/1.1 and the
commit protocol covers lost executors.  Files are gzipped as a whole (one member), and have no warcinfo.

Reading (streaming) takes archives of other writers as well: names of fields in any case, folded
lines, any record types, digests or lengths that are missing, gzip members of any number.
Spark's text reader gives the archives in order, in pieces split at CRLF
CRLF; a parser of the joined bytes emits *chunk rows*: record identifier, chunk number, bytes,
and the digest of the payload so far.  It holds one chunk at a time, never a
record; a record's last chunk has its length and digest.

Defined cases: a null html is an empty payload; identifiers of any characters come back as they were
(percent-encoded in the archive); pages that tie in the smallest identifier are
all responses; a null identifier is larger than any other, and revisits of a group that has
only nulls don't exist (all tie); every page has one record, repeated ones too; an empty table
gives an empty archive.  A header that announces more bytes than there are raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import col, members_bitmap, scratch, spread_join, staged, with_maybe

END = "\r\n\r\n"
CHUNK_BYTES = 1 << 16
#: Written into every record: a wall-clock date would make reruns differ.
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(sha1: Column) -> Column:
    """Base32 of 40 hex digits: four times ten digits are 40 bits are eight letters."""
    bits = [F.lpad(F.conv(F.substring(sha1, 10 * i + 1, 10), 16, 2), 40, "0") for i in range(4)]
    letters = [
        F.substring(F.lit(BASE32), F.conv(F.substring(b, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for b in bits for i in range(8)
    ]
    return F.concat(*letters)


def roles(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, payload) with digests, record type and the page they refer to.

    Payloads stay where they are, but for those that may be a group's response: two bitmaps tell what surely
    has no equal, and what surely is not the first of its equals.  The latter move without their payload.
    """
    digested = pages.withColumn(
        "key", F.struct(F.length("payload").alias("n"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"))
    )
    groups = staged(digested.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("size")), "payloads")
    several = groups.where("size > 1")
    flagged = with_maybe(digested, members_bitmap(several, "key"), "key", flag="__several")
    firsts = members_bitmap(groups.select("key", F.col("first").alias("page_id")), "key", "page_id")
    flagged = with_maybe(flagged, firsts, "key", "page_id", flag="__first")
    alone = flagged.where("not __several").withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType))
    leading = spread_join(flagged.where("__several and __first").drop("__several", "__first"), several, "key", "size", "left")
    behind = flagged.where("__several and not __first").select("page_id", "url", "key")  # revisits
    behind = spread_join(behind, several, "key", "size", "left").withColumn("payload", F.lit(None).cast("binary"))
    columns = ["page_id", "url", "payload", "key", "first"]
    met = alone.select(*columns).unionByName(leading.select(*columns)).unionByName(behind.select(*columns))
    again = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    return met.select(
        "page_id", "url", "payload", F.col("key.n").alias("n"), F.col("key.sha1").alias("sha1"),
        F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def record_urn(page_id: Column, sha1: Column) -> Column:
    """The identifier of a page's record."""
    return F.concat(F.lit("<urn:md5:"), F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), sha1, F.lit(DATE))), F.lit(">"))


def encoded(page_id: Column) -> Column:
    """An identifier as a header's value: whatever could end or trim a line is percent-encoded."""
    return F.replace(F.url_encode(page_id.cast("string")), F.lit("+"), F.lit("%20"))


def decoded(value: str | None) -> str | None:
    return None if value is None else urllib.parse.unquote(value)


def records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per WARC record (a chunk of a page), without the CRLF CRLF at its end."""
    body = F.when(F.col("type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    rows = roles(pages).withColumn("body", body).drop("payload")
    rows = rows.withColumn("uri", F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20]", "%20"))
    rows = rows.withColumn("digest", base32_of_hex(F.col("sha1")))
    rows = rows.withColumn("uid", record_urn(F.col("page_id"), F.col("sha1")))
    rows = rows.withColumn("last", F.greatest(F.lit(1), F.ceil(F.length("body") / F.lit(chunk_bytes))).cast("int"))
    rows = rows.withColumn("no", F.explode(F.sequence(F.lit(1), F.col("last"))))
    rows = rows.withColumn("chunk", F.expr(f"substring(body, (no - 1) * {chunk_bytes} + 1, {chunk_bytes})"))
    http = F.when(F.col("no") == 1, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END)))
    block = F.concat(F.coalesce(http, F.lit("")).cast("binary"), F.col("chunk"))
    more = F.col("last") > 1

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value.cast("string")))

    first, cont = F.col("no") == 1, F.col("no") > 1
    parts = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(cont, "continuation").otherwise(F.col("type")),
        field("WARC-Record-ID", F.when(cont, F.concat(F.lit("<urn:segment:"), F.substring(F.col("uid"), 10, 32), F.lit(":"), F.col("no").cast("string"), F.lit(">"))).otherwise(F.col("uid"))),
        field("WARC-Date", F.lit(DATE)), field("WARC-Target-URI", F.col("uri")), field("X-Page-Id", encoded(F.col("page_id"))),
        field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1("block")))),
        field("WARC-Profile", F.when(first & (F.col("type") == "revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        field("X-Refers-To-Page-Id", F.when(first, encoded(F.col("refers_to")))),
        field("WARC-Refers-To", F.when(first & F.col("refers_to").isNotNull(), record_urn(F.col("refers_to"), F.col("sha1")))),
        field("WARC-Segment-Number", F.when(more, F.col("no"))),
        field("WARC-Segment-Origin-ID", F.when(cont, F.col("uid"))),
        field("WARC-Segment-Total-Length", F.when(more & (F.col("no") == F.col("last")), F.col("n"))),
        field("Content-Type", F.when(cont, "application/octet-stream").otherwise("application/http; msgtype=response")),
        field("Content-Length", F.length("block")), F.lit(END),
    ]
    head = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    return rows.withColumn("block", block).select(F.concat(head.cast("binary"), F.col("block")).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one logical record per row of ``pages`` to gzipped WARC files in a new folder."""
    html = F.coalesce(col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), html.alias("payload"))
    out = records(rows, chunk_bytes).select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").text(path)


def header_fields(head: str) -> dict[str, str]:
    """Fields of a header by lower-case name; its first line is none.  A line that starts with
    white space goes on with the one before."""
    fields, name = {}, None
    for line in head.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


class Reader:
    """Parses the bytes of one archive, given in any pieces, into chunk rows.

    Holds a header or a chunk of at most ``chunk_bytes`` and a digest, never a record.
    """

    def __init__(self, verify: bool = True, chunk_bytes: int = CHUNK_BYTES):
        self.verify, self.chunk_bytes = verify, chunk_bytes
        self.state, self.buffer, self.left = "head", b"", 0
        self.head: dict[str, str] = {}
        self.origin: dict[str, str] = {}

    @property
    def between(self) -> bool:
        return self.state == "head" and not self.buffer

    def feed(self, data: bytes) -> Iterator[dict]:
        while data:
            if self.state == "tail":  # the CRLF CRLF after a block
                take = min(len(data), self.left)
                self.left -= take
                data = data[take:]
                if not self.left:
                    self.state = "head"
                continue
            if self.state == "head":
                # line breaks between records are skipped: a file's last piece may lack its separator
                self.buffer += data if self.buffer else data.lstrip(b"\r\n")
                head, found, data = self.buffer.partition(END.encode())
                if found:
                    self.buffer = b""
                    yield from self.begin(head)
                continue
            take = data[: self.left]
            self.left -= len(take)
            data = data[len(take) :]
            self.block.update(take)
            self.buffer += take
            if self.state == "http":
                http, found, rest = self.buffer.partition(END.encode())
                if found:
                    fields = header_fields(http.decode("utf-8", "replace"))
                    length = fields.get("content-length", "")
                    self.total = int(length) if length.isdigit() and self.segmented else None
                    self.buffer, self.state = rest, "block"
                elif self.left:
                    continue
                else:  # no HTTP header: all of it is payload
                    self.state = "block"
            while len(self.buffer) >= self.chunk_bytes and (self.left or len(self.buffer) > self.chunk_bytes):
                yield self.row(self.buffer[: self.chunk_bytes], False)
                self.buffer = self.buffer[self.chunk_bytes :]
            if not self.left:
                yield from self.end_block()

    def end_block(self) -> Iterator[dict]:
        yield self.row(self.buffer, True)
        self.buffer, self.state, self.left = b"", "tail", len(END)
        self.compare(self.block, self.head.get("warc-block-digest"))

    def begin(self, head: bytes) -> Iterator[dict]:
        version, _, rest = head.decode("utf-8", "replace").partition("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not at the start of a record")
        self.head = header_fields(f"{version}\r\n{rest}")
        self.left, self.block, self.state = int(self.head["content-length"]), hashlib.sha1(), "block"
        if self.head["warc-type"] != "continuation":
            self.origin, self.sha1, self.size, self.no, self.total = self.head, hashlib.sha1(), 0, 0, None
            self.segmented = "warc-segment-number" in self.head or self.head["warc-type"] == "revisit"
            if "application/http" in self.head.get("content-type", "").lower():
                self.state = "http"
        if not self.left:
            yield from self.end_block()

    def compare(self, digest, said: str | None) -> None:
        """Digests by SHA-1 are verified; others and missing ones are not."""
        if self.verify and said and said.lower().startswith("sha1:"):
            if base64.b32encode(digest.digest()).decode() != said[5:].upper() and digest.hexdigest() != said[5:].lower():
                raise ValueError(f"digest differs in {self.head.get('warc-record-id')}")

    def row(self, data: bytes, ends_block: bool) -> dict:
        head, revisit = self.origin, self.origin["warc-type"] == "revisit"
        self.sha1.update(data)
        self.size += len(data)
        self.no += 1
        last = ends_block and (revisit or self.total is None or self.size == self.total)
        said = head.get("warc-payload-digest")
        if last and not revisit:
            self.compare(self.sha1, said)
        return {
            "record_id": head.get("warc-record-id"), "page_id": decoded(head.get("x-page-id")), "record_type": head["warc-type"],
            "refers_to": decoded(head.get("x-refers-to-page-id")), "chunk_no": self.no - 1, "data": data,
            "bytes_so_far": self.total if revisit and self.total is not None else self.size,
            "digest_so_far": said.partition(":")[2] if revisit and said else base64.b32encode(self.sha1.digest()).decode(), "is_last": last,
        }


CHUNK_FIELDS = [
    ("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
    ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()),
]
CHUNK_SCHEMA = (
    "record_id string, page_id string, record_type string, refers_to string, chunk_no bigint, data binary, "
    "bytes_so_far bigint, digest_so_far string, is_last boolean"
)
#: Chunk rows leave the reader in batches of about this many bytes.
BATCH_BYTES = 4 << 20


def read_archives(spark: SparkSession, path: str, verify: bool = True, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives of a folder: see CHUNK_SCHEMA.

    Gzipped files are not split, and the pieces of a file arrive in order.  Digests are
    verified unless told otherwise; ``with_data=False`` leaves the bytes out of the rows.
    """
    pieces = spark.read.option("lineSep", END).text(path).select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: tuple[str | None, Reader] = (None, Reader(verify))
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in CHUNK_FIELDS], names=[n for n, _ in CHUNK_FIELDS])

        for batch in batches:
            for piece, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if file != readers[0]:
                    if not readers[1].between:
                        raise ValueError(f"{readers[0]} ends within a record")
                    readers = (file, Reader(verify))
                for row in readers[1].feed(piece.as_py() + END.encode()):
                    size += len(row["data"]) + 200
                    rows.append(row if with_data else row | {"data": None})
                if size >= BATCH_BYTES:
                    yield flush()
                    rows, size = [], 0
        if not readers[1].between:
            raise ValueError(f"{readers[0]} ends within a record")
        if rows:
            yield flush()

    return pieces.mapInArrow(run, CHUNK_SCHEMA)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path, with_data=False).where("is_last").select(
        F.col("page_id").cast(kind).alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


QUERIES = {"op4_warc": op4_warc}
# base32: a letter's five bits lie in two hex digits, from the first or one of the next three bits on
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT *, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + CAST((('0x' || substr(h || '0', 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
ORACLES = {"op4_warc": ORACLE}
