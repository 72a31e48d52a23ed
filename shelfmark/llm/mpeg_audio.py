"""Media columns: MPEG audio streams in a binary column.

Storing.  A payload of any bytes becomes an MPEG-1 layer III stream: an ID3v2.3 tag (with the
CRC-32 of its frames and the payload's length), a frame with the variable-bitrate table (Xing:
frame count, byte count, seek table), then silent frames of 48 kHz stereo whose ancillary data -
what a frame holds beyond its (empty) main data - carry the payload, and an ID3v1 tag.  Frames
have 320 kbit/s, the last one the least rate that holds the rest.  Every frame has its CRC-16.

Probing reads any stream with a bitrate: ID3v1, ID3v2.2 to 2.4 (unsynchronised ones too), Xing,
Info and VBRI tables are parsed; frame headers of all versions and layers are followed from one
to the next, and where one is missing or the next does not agree, the stream is searched for the
next pair that does (a resync).  CRCs of layer III frames and of tags are verified (those of
layers I and II cover decoded bit allocations and are not).  Stored are the duration of all
frames (samples over sample rate, exact; an encoder's delay is not taken off) and each frame's
offset.

Defined cases: a null text is empty; the payload is the text's UTF-8 filled with zeros to a
positive multiple of 64 bytes; equal texts give equal streams; every row gives one row; a
stream without frames has 0 frames, no payload and duration 0.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import col

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1 or not, layer), Hz, samples.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
UNIT = 64


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    sample_rate: int
    channels: int
    length: int
    samples: int
    side_info: int

    def agrees(self, other: Header) -> bool:
        return (self.version, self.layer, self.sample_rate) == (other.version, other.layer, other.sample_rate)


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """The header in four bytes, or None (free-format streams have none that can be followed)."""
    if raw in _headers:
        return _headers[raw]
    out = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] >= 0xE0:
        version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
        rate, hz = raw[2] >> 4, raw[2] >> 2 & 3
        if version and layer < 4 and 0 < rate < 15 and hz < 3:
            kbit, sample_rate, pad = BITRATES[version == "1", layer][rate], SAMPLE_RATES[version][hz], raw[2] >> 1 & 1
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == "1" else 576
            length = (12000 * kbit // sample_rate + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // sample_rate + pad
            mono = raw[3] >> 6 == 3
            side = 0 if layer < 3 else (17 if mono else 32) if version == "1" else (9 if mono else 17)
            out = Header(version, layer, not raw[1] & 1, kbit, sample_rate, 1 if mono else 2, length, samples, side)
    if len(_headers) < 4096:
        _headers[raw] = out
    return out


SIDE = bytes(32)


def frame_head(rate: int, protected: bool = True) -> bytes:
    """Header, CRC and empty side information of a 48 kHz stereo layer III frame."""
    raw = bytes((0xFF, 0xFA if protected else 0xFB, rate << 4 | 1 << 2, 0))
    return raw + (struct.pack(">H", crc16(raw[2:] + SIDE)) if protected else b"") + SIDE


HEADS = {rate: frame_head(rate) for rate in range(1, 15)}
ROOM = {rate: header(HEADS[rate][:4]).length - len(HEADS[rate]) for rate in HEADS}
TABLE_RATE = 5  # 192 bytes, enough for the table of 120


def id3v2(payload_bytes: int) -> bytes:
    """ID3v2.3 tag with an extended header that holds the CRC-32 of the frames."""
    text = b"\0payload-bytes\0" + str(payload_bytes).encode()
    frames = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    body = struct.pack(">IHII", 10, 0x8000, 0, zlib.crc32(frames)) + frames
    n = len(body)
    return b"ID3\3\0\x40" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


def store(payload: bytes) -> bytes:
    """An MPEG audio stream that holds the payload."""
    frames, at, full = [], 0, ROOM[14]
    while len(payload) - at > full:
        frames.append(HEADS[14] + payload[at : at + full])
        at += full
    rest = payload[at:]
    rate = next(r for r in HEADS if ROOM[r] >= len(rest))
    frames.append(HEADS[rate] + rest.ljust(ROOM[rate], b"\0"))
    audio = b"".join(frames)
    table = frame_head(TABLE_RATE, False)
    length = header(table[:4]).length
    total, count = length + len(audio), len(frames) + 1
    starts = [0, *[length + i * 960 for i in range(len(frames))]]
    toc = bytes(min(255, starts[i * count // 100] * 256 // total) for i in range(100))
    vbr = (table + b"Xing" + struct.pack(">III", 0xF, count, total) + toc + struct.pack(">I", 0)).ljust(length, b"\0")
    return id3v2(len(payload)) + vbr + audio + b"TAG".ljust(128, b"\0")


@dataclass
class Probe:
    tags: list[str] = field(default_factory=list)
    frames: list[str] = field(default_factory=list)  # names of tag frames
    tag_crc_ok: bool | None = None
    payload_bytes: int | None = None
    vbr: tuple[int, int] | None = None  # frames and bytes that the table announces
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)  # of frames, the table's own left out
    samples: int = 0
    sample_rate: int = 0
    kinds: Counter = field(default_factory=Counter)  # (version, layer, kbit/s) -> frames
    crc_checked: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    bodies: list[bytes] = field(default_factory=list)

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.sample_rate) if self.sample_rate else Fraction(0)

    @property
    def payload(self) -> bytes | None:
        data = b"".join(self.bodies)
        return data[: self.payload_bytes] if self.payload_bytes is not None and self.payload_bytes <= len(data) else None


_crcs: dict[bytes, int] = {}


def crc_of(data: bytes) -> int:
    if data not in _crcs:
        if len(_crcs) > 4096:
            _crcs.clear()
        _crcs[data] = crc16(data)
    return _crcs[data]


def synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def read_id3v2(data: bytes, out: Probe) -> int:
    """Parse a tag at the start; return where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    version, flags, size = data[3], data[5], synchsafe(data[6:10])
    out.tags.append(f"ID3v2.{version}")
    body = data[10 : 10 + size]
    end = 10 + size + 10 * bool(version == 4 and flags & 0x10)  # a footer
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if version == 3 and flags & 0x40 and len(body) >= 14:
        ext, ext_flags = struct.unpack(">IH", body[:6])
        said = struct.unpack(">I", body[10:14])[0] if ext_flags & 0x8000 and ext >= 10 else None
        body = body[4 + ext :]
        if said is not None:
            out.tag_crc_ok = zlib.crc32(body) == said
    elif version == 4 and flags & 0x40 and len(body) >= 6:
        body = body[synchsafe(body[:4]) :]
    if version not in (2, 3, 4):
        return end
    name, head = (3, 6) if version == 2 else (4, 10)
    at = 0
    while at + head <= len(body) and body[at]:
        raw = body[at + name : at + 2 * name]
        n = synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        value = body[at + head : at + head + n]
        if version == 4 and body[at + 9] & 2:  # this frame is unsynchronised
            value = value.replace(b"\xff\x00", b"\xff")
        if not n:
            break
        out.frames.append(body[at : at + name].decode("latin-1"))
        if value.startswith(b"\0payload-bytes\0") and value[15:].isdigit():
            out.payload_bytes = int(value[15:])
        at += head + n
    return end


def vbr_table(data: bytes, side: int, body: int) -> tuple[tuple[int, int], bytes] | None:
    """((frames, bytes), seek table) that a frame announces; side, body: where its side information
    begins and ends."""
    if data[body : body + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(data[body + 4 : body + 8], "big")
        where, said = body + 8, []
        for bit in (1, 2):
            said.append(int.from_bytes(data[where : where + 4], "big") if flags & bit else 0)
            where += 4 if flags & bit else 0
        return tuple(said), data[where : where + 100] if flags & 4 else b""
    where = side + 32  # whatever the frame's own side information
    if data[where : where + 4] == b"VBRI" and len(data) >= where + 26:
        size, frames, entries, _, width = struct.unpack(">IIHHH", data[where + 10 : where + 24])
        return (frames, size), data[where + 26 : where + 26 + entries * width]
    return None


def probe(data: bytes) -> Probe:
    """Follow the frames of a stream."""
    out = Probe()
    at, end = read_id3v2(data, out), len(data)
    if data[-128:-125] == b"TAG" and end >= 128:
        out.tags.append("ID3v1")
        end -= 128
    lost = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        following = at + h.length if h else 0
        if h and following <= end:
            nxt = header(data[following : following + 4]) if following + 4 <= end else h
            good = following == end or (nxt is not None and nxt.agrees(h))
        else:
            good = False
        if not good:
            if not lost:
                out.resyncs += 1
            lost = True
            again = data.find(b"\xff", at + 1, end)
            out.skipped += (again if again >= 0 else end) - at
            at = again if again >= 0 else end
            continue
        lost = False
        head = at + 4 + 2 * h.protected
        body = head + h.side_info
        if h.protected and h.layer == 3:
            out.crc_checked += 1
            out.crc_bad += crc_of(data[at + 2 : at + 4] + data[head:body]) != data[at + 4] << 8 | data[at + 5]
        found = vbr_table(data[at:following], head - at, body - at) if not out.offsets and out.vbr is None else None
        if found:
            out.vbr, out.toc = found
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.sample_rate = h.sample_rate
            out.kinds[h.version, h.layer, h.bitrate] += 1
            out.bodies.append(data[body:following])
        at = following
    return out


def feature(p: Probe) -> str:
    """What the stream is, in one line of JSON."""
    first = next(iter(p.kinds), None)
    return json.dumps({
        "codec": f"MPEG-{first[0]} layer {first[1]}" if first else None, "sample_rate": p.sample_rate, "frames": len(p.offsets),
        "samples": p.samples, "duration_s": str(p.duration), "kbit_s": {str(k[2]): n for k, n in sorted(p.kinds.items())},
        "vbr_table": list(p.vbr) if p.vbr else None, "toc_entries": len(p.toc), "tags": p.tags, "tag_crc_ok": p.tag_crc_ok,
        "frame_crc": [p.crc_checked, p.crc_bad], "resyncs": p.resyncs, "skipped_bytes": p.skipped,
    }, separators=(",", ":"))


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


#: Rows leave a task in batches of about this many bytes.
BATCH_BYTES = 8 << 20


def batches_of(rows: Iterable[tuple], weigh, types: list[tuple]) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part), types)], names=[n for n, _ in types])
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part), types)], names=[n for n, _ in types])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, media (the stored stream)."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [("doc_id", batch.column(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())]

            def each(batch=batch):
                for i, t in zip(batch.column(0), batch.column(1)):
                    n, payload = payload_of(t.as_py())
                    yield i.as_py(), n, store(payload)

            yield from batches_of(each(), lambda r: len(r[2]), types)

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


PROBED = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "frames bigint, samples bigint, sample_rate int, seek_offsets array<bigint>, crc_bad bigint, resyncs bigint"
)


def probe_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns of ``media``, and what the stored streams say: see PROBED."""
    keep = [c for c in media.columns if c != media_col]
    rows = media.select(*keep, media_col)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            types = [(c, batch.column(i).type) for i, c in enumerate(keep)] + [("payload_bytes", pa.int64()), *zip(names, own)]
            types += [("frames", pa.int64()), ("samples", pa.int64()), ("sample_rate", pa.int32()), ("seek_offsets", pa.list_(pa.int64()))]
            types += [("crc_bad", pa.int64()), ("resyncs", pa.int64())]

            def each(batch=batch):
                kept = [batch.column(i).to_pylist() for i in range(len(keep))]
                for i, value in enumerate(batch.column(len(keep))):
                    data = value.as_py() or b""
                    p = probe(data)
                    got = p.payload
                    yield (
                        *[k[i] for k in kept], None if got is None else len(got), None if got is None else hashlib.sha256(got).hexdigest(),
                        None if got is None else zlib.crc32(got[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(p),
                        len(p.offsets), p.samples, p.sample_rate, p.offsets, p.crc_bad, p.resyncs,
                    )

            yield from batches_of(each(), lambda r: 600 + 8 * r[-4], types)

    return rows.mapInArrow(run, f"{fields + ', ' if keep else ''}{PROBED}")


def op9_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return probe_media(store_texts(docs))


QUERIES = {"op9_mpeg_audio": op9_mpeg_audio}
ORACLES: dict[str, str] = {}
