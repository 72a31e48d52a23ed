"""Naming conventions as Column expressions (no Python UDF).

Kebab and snake split at a lower-case ASCII letter followed by an upper-case one and drop all
other characters; camel and Pascal lower-case first, so they are not idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.config import CAMEL, KEBAB, PASCAL, SNAKE, NamingConvention
from shelfmark.functions.paths import raw_extension, stem

# Fixed value: white space of an ECMAScript regular expression.
SPACE = r"\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def kebab(name: Column) -> Column:
    out = F.regexp_replace(name, r"([a-z])([A-Z])", "$1-$2")
    out = F.regexp_replace(out, f"[{SPACE}_]+", "-")
    return F.lower(F.regexp_replace(out, r"[^a-zA-Z0-9-]", ""))


def snake(name: Column) -> Column:
    out = F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, f"[{SPACE}-]+", "_")
    return F.lower(F.regexp_replace(out, r"[^a-zA-Z0-9_]", ""))


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def camel(name: Column) -> Column:
    parts = F.split(F.lower(name), f"[{SPACE}_-]+")
    return F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(capitalised(w))), "")


def pascal(name: Column) -> Column:
    return capitalised(camel(name))


STYLES = {KEBAB: kebab, SNAKE: snake, CAMEL: camel, PASCAL: pascal}


def apply_convention(name: Column, convention: NamingConvention) -> Column:
    """A file name under a convention; an unknown type keeps the stem; the extension is lowered."""
    body = STYLES.get(convention.type, lambda c: c)(stem(name))
    if convention.lowercase and convention.type not in (CAMEL, PASCAL):
        body = F.lower(body)
    return F.concat(body, F.lower(raw_extension(name)))


def needs_rename(name: Column, convention: NamingConvention) -> Column:
    return name != apply_convention(name, convention)
