"""POSIX path functions as Column expressions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def filename(path: Column) -> Column:
    """Last segment of a path."""
    return F.substring_index(path, "/", -1)


def raw_extension(name: Column) -> Column:
    """``extname``: from the last dot on, unless that dot is the first character."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)


def extension(name: Column) -> Column:
    return F.lower(raw_extension(name))


def stem(name: Column) -> Column:
    """A file name without its extension."""
    return F.left(name, F.length(name) - F.length(raw_extension(name)))


def dirname(path: Column) -> Column:
    """All but the last segment: ``.`` for a bare name, ``/`` for an entry of the root."""
    head = F.regexp_replace(path, r"/+[^/]*$", "")
    return F.when(~path.contains("/"), F.lit(".")).when(head == "", F.lit("/")).otherwise(head)


def _fold(path: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes segment by segment."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(acc: Column, s: Column) -> Column:
        top = F.when(F.size(acc) > 0, F.element_at(acc, -1))
        pop = (s == "..") & top.isNotNull() & (top != "..")
        stay = (s == "..") & top.isNull() & absolute
        return (
            F.when(pop, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(stay, acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    body = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    out = F.concat(F.when(absolute, "/").otherwise(""), body)
    out = F.when(path.endswith("/") & (body != ""), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(out == "", F.lit(".")).otherwise(out)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize(path: Column) -> Column:
    """``normalize``: only paths that need it pay for more than a regex test."""
    return bound(path, lambda p: F.when(p.rlike(r"//|(^|/)\.{1,2}(/|$)") | (p == ""), _fold(p)).otherwise(p))


def join(*parts: Column | str) -> Column:
    """``join``: empty parts are skipped, the result is normalised."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return normalize(F.concat_ws("/", F.nullif(cols[0], F.lit("")), *cols[1:]))


def is_clean(path: str) -> bool:
    """Whether a relative path has no empty, ``.`` or ``..`` segment."""
    return not any(part in ("", ".", "..") for part in path.split("/"))


def clean(path: str) -> str:
    """The driver's ``normalize`` for a root (without a trailing slash)."""
    return posixpath.normpath(path) if not path.startswith("//") else posixpath.normpath(path[1:])
