"""First-match classification by very many rules with patterns.

Each glob has literal strings that a path must have to match (``functions.globs.literals``).  For every extension, one
Aho-Corasick automaton holds of each glob the literal that the fewest others share; a path goes through it once, and what
is found are its candidates, which are tried in the order of the rules until one matches.  So the work of a path grows with
what it has in common with patterns, not with the number of rules.  Globs without literals are candidates of every path.

The index is made on the driver from the list of rules, broadcast, and compiled once per Python worker; files stay where they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.config import Rule
from shelfmark.functions.globs import END, START, glob_regex, literals


class PatternIndex:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        #: By extension: the first rule without patterns.
        self.free: dict[str, int] = {}
        #: By extension: (literal, rule, pattern) of the patterns of rules before that.
        self.entries: dict[str, list[tuple[str, int, str]]] = {}
        found = {p: literals(p) for r in self.rules for p in r.patterns or ()}
        common = Counter(x for options in found.values() for own in options for x in set(own))
        for place, rule in enumerate(self.rules):
            for ext in dict.fromkeys(rule.extensions):
                if ext in self.free:
                    continue
                if rule.patterns is None:
                    self.free[ext] = place
                for pattern in rule.patterns or ():
                    for own in found[pattern]:
                        best = min(own, key=lambda x: (common[x], -len(x), x), default="")
                        self.entries.setdefault(ext, []).append((best, place, pattern))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("compiled", "values")}

    @cached_property
    def compiled(self) -> dict[str, tuple]:
        """By extension: (automaton or None, the entries without literals)."""
        import ahocorasick

        out = {}
        for ext, entries in self.entries.items():
            by: dict[str, list[tuple[int, str]]] = {}
            for literal, place, pattern in entries:
                by.setdefault(literal, []).append((place, pattern))
            always, automaton = by.pop("", []), None
            if by:
                automaton = ahocorasick.Automaton()
                for literal, own in by.items():
                    automaton.add_word(literal, own)
                automaton.make_automaton()
            out[ext] = automaton, always
        return out

    @cached_property
    def values(self) -> tuple[pa.Array, pa.Array]:
        """The rules' names and target folders."""
        return pa.array([r.name for r in self.rules], pa.string()), pa.array([r.target_folder for r in self.rules], pa.string())

    def candidates(self, ext: str, path: str) -> list[tuple[int, str]]:
        """(rule, pattern) that may match, in the order of the rules."""
        automaton, always = self.compiled.get(ext, (None, []))
        out = list(always)
        if automaton is not None:
            for _, own in automaton.iter(f"{START}{path}{END}"):
                out += own
        return sorted(set(out))

    def first(self, ext: str | None, path: str | None) -> int | None:
        """The place of the first rule that matches."""
        if ext is None or path is None:
            return None
        free = self.free.get(ext)
        for place, pattern in self.candidates(ext, path):
            if free is not None and place > free:
                break
            if expression(pattern).search(path):
                return place
        return free


_EXPRESSIONS: dict[str, re.Pattern] = {}


def expression(pattern: str) -> re.Pattern:
    """Compiled when a path first comes near the pattern; one per process."""
    if pattern not in _EXPRESSIONS:
        _EXPRESSIONS[pattern] = re.compile(glob_regex(pattern))
    return _EXPRESSIONS[pattern]


def classify_by_index(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``category`` and ``target_folder`` (null where no rule matches); the same as ``classify``."""
    index = PatternIndex(rules)
    shared = files.sparkSession.sparkContext.broadcast(index)  # as large as the list of rules

    @F.arrow_udf("struct<category:string,target_folder:string>")
    def first(ext: pa.Array, path: pa.Array) -> pa.Array:
        own = shared.value
        place = pa.array([own.first(e, p) for e, p in zip(ext.to_pylist(), path.to_pylist(), strict=True)], pa.int32())
        return pa.StructArray.from_arrays([x.take(place) for x in own.values], names=["category", "target_folder"])

    met = files.withColumn("__first", first(F.col("extension"), F.col("rel_path")))
    return met.withColumns({"category": F.col("__first.category"), "target_folder": F.col("__first.target_folder")}).drop("__first")
