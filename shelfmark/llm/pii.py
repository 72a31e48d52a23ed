"""Personal data in texts: patterns propose spans, checksums confirm them, context adjusts scores.

Kinds and what confirms them:

======  ==========================================================  =========================
kind    proposed by                                                 confirmed by
======  ==========================================================  =========================
email   local part, ``@``, dotted domain                            the pattern
ip      four dotted decimal numbers                                 each at most 255
card    digits with single spaces or hyphens between                14-19 digits and Luhn
phone   ``+`` and a run of digits, spaces, ``().-``                 10-15 digits
iban    two letters, two digits, 11-30 letters or digits            country length and mod-97
ssn     ddd-dd-dddd                                                 area, group, serial ranges
======  ==========================================================  =========================

The first four (the base) are reported whenever confirmed.  Each span has a score: a prior for
its kind, raised by a checksum and by context words of its kind nearby, lowered by words that
speak against it.  ``iban`` and ``ssn`` are reported from ``min_score`` on, so an unprefixed
``ssn`` needs a context word, while a valid ``iban`` does not.

Matching takes time linear in the text, however long runs of digits or ``@`` are.  Defined
cases: a null text is empty and has no span; spans of different kinds may overlap; offsets are
code points, end exclusive; every input row gives one row, repeated ones too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import col

# Kinds in their order, priors, context words, IBAN lengths by country.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = ("email", "ip", "card", "phone")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.6, "phone": 0.5, "iban": 0.6, "ssn": 0.3}
CHECKED = {"card", "iban"}
CONTEXT = {  # English, German, French, Spanish
    "email": {"email", "mail", "contact", "write", "kontakt", "schreiben", "courriel", "écrire", "correo", "contacto", "escribir"},
    "ip": {"ip", "address", "host", "server", "login", "adresse", "serveur", "hôte", "dirección", "servidor"},
    "card": {
        "card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "kreditkarte", "zahlung", "carte", "crédit", "paiement",
        "tarjeta", "crédito", "pago",
    },
    "phone": {
        "phone", "tel", "call", "mobile", "fax", "telephone", "telefon", "handy", "anrufen", "téléphone", "appeler", "teléfono", "móvil", "llamar",
    },
    "iban": {"iban", "bank", "account", "transfer", "konto", "überweisung", "banque", "compte", "virement", "banco", "cuenta", "transferencia"},
    "ssn": {"ssn", "social", "security", "taxpayer", "sozialversicherung", "sécurité", "sociale", "seguridad"},
}
AGAINST = {
    "example", "version", "sample", "order", "invoice", "isbn", "build", "beispiel", "bestellung", "rechnung", "exemple", "commande", "facture",
    "ejemplo", "pedido", "factura",
}
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A digit run is tried from its first digit only: later starts fail for the same reason.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}(?=[0-9]{2})")
IBAN_REST = {c: re.compile(r"[0-9]{2}(?: ?[A-Za-z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for c, n in IBAN_LENGTH.items()}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
WORDS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"[0-9]")
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end) in no particular order."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(map(small, m.groups())):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.findall(m[0])) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        country = m[0].upper()
        rest = country in IBAN_REST and IBAN_REST[country].match(text, m.end())
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            yield "iban", m.start(), rest.end()
    for m in SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW // 2]
    words = {w.lower() for w in WORDS.findall(near)}
    value = PRIOR[kind] + 0.3 * (kind in CHECKED)
    value += 0.3 * bool(words & CONTEXT[kind]) - 0.2 * bool(words & AGAINST)
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str | None, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by start, then kind."""
    text = text or ""
    found = [(kind, a, b, score(text, kind, a, b)) for kind, a, b in proposals(text)]
    found = [x for x in found if x[0] in BASE or x[3] >= min_score]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = "struct<kind:string,start:int,end:int,score:double>"
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array<struct<kind,start,end,score>>."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t.as_py(), min_score)] for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, ARROW_SPAN)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<{SPAN}>")


def redact(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans merge."""
    out, end = [], 0
    for kind, start, stop, *_ in spans:
        if start >= end:
            out += [text[end:start], f"[{kind}]"]
        end = max(end, stop)
    return "".join(out) + text[end:]


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(only_base: bool):
        spans = F.filter("spans", lambda s: s["kind"].isin(*BASE)) if only_base else F.col("spans")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE), F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
