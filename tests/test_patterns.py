"""Ranges, literals and the index of many patterns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.config import Rule
from shelfmark.functions import globs
from shelfmark.operators.classify import first_match, with_names
from shelfmark.operators.pattern_index import PatternIndex, classify_by_index
from shelfmark.plans import queries


@pytest.mark.parametrize("low,high", [(1, 20_000), (0, 100), (7, 1234), (-250, 40), (-300, -20), (999, 100_001), (120, 5)])
def test_long_ranges(low, high):
    pattern = re.compile(globs.glob_regex(f"f{{{low}..{high}}}.txt"))
    values = set(range(min(low, high), max(low, high) + 1))
    for v in {*list(values)[::7], low, high, low - 1, high + 1, -low, 0, 10 * high, 5, 99, 100}:
        assert bool(pattern.search(f"f{v}.txt")) == (v in values), v
    assert not pattern.search("f.txt") and not pattern.search("f01.txt")


def test_padded_ranges():
    pattern = re.compile(globs.glob_regex("{001..250}"))
    assert [v for v in ("001", "1", "099", "250", "251", "0001", "000") if pattern.search(v)] == ["001", "099", "250"]
    with pytest.raises(ValueError, match="too long"):
        globs.glob_regex("{1..100000..3}")


def test_end_is_the_very_end():
    assert not re.search(globs.glob_regex("*.txt"), "a.txt\n") and re.search(globs.glob_regex("!*.txt"), "a.txt\n")


PIECES = ["a", "b1", "src", "*", "**", "?", "*.txt", "a*b", "[ab]*", "{a,b}", "x\\*y", "+(a|b)", "!(a|b)c", "@(src|lib)", "rep-*.txt", "[", "b?.txt", "{1..300}"]
SEGMENTS = ["a", "b1", "src", "lib", "ab", "axb", "x*y", "aab", "c", "rep-1.txt", "b2.txt", "7.txt", ".h", "[", "17", "bc"]


def some_pattern(rng):
    return ("!" if rng.random() < 0.05 else "") + "/".join(rng.choice(PIECES) for _ in range(rng.randint(1, 4)))


def test_literals_are_necessary():
    rng = random.Random(5)
    hits = 0
    for _ in range(6000):
        pattern, path = some_pattern(rng), "/".join(rng.choice(SEGMENTS) for _ in range(rng.randint(1, 4)))
        if re.search(globs.glob_regex(pattern), path):
            hits += 1
            assert any(all(x in f"{globs.START}{path}{globs.END}" for x in own) for own in globs.literals(pattern)), (pattern, path)
    assert hits > 200


def test_index_equals_branches(spark):
    rng = random.Random(6)
    exts = (".txt", "", ".md")
    rules = [
        Rule(f"r{i}", tuple(rng.sample(exts, rng.randint(0, 3))), rng.choice([None, (), *[tuple(some_pattern(rng) for _ in range(rng.randint(1, 3))) for _ in range(20)]]), rng.choice([None, "t"]))
        for i in range(60)
    ]
    paths = [("/".join(rng.choice(SEGMENTS) for _ in range(rng.randint(1, 4))),) for _ in range(800)] + [(None,)]
    files = with_names(spark.createDataFrame(paths, "rel_path string"))
    ext, path = F.col("extension"), F.col("rel_path")
    got = classify_by_index(files, rules).withColumn("c", first_match(rules, ext, path, "name")).withColumn("t", first_match(rules, ext, path, "target_folder"))
    rows = got.collect()
    assert all((r.category, r.target_folder) == (r.c, r.t) for r in rows) and len({r.category for r in rows}) > 5


def test_work_grows_with_matches():
    """Ten times the rules leave the candidates as they are, and the time nearly so."""
    paths = [f"type/{k}/name {k % 50}.txt" for k in range(3000)]
    small, large = PatternIndex(queries.MANY[:1000]), PatternIndex(queries.MANY)
    for index in (small, large):
        index.first(".txt", "x")  # compiled
    assert max(len(large.candidates(".txt", p)) for p in paths) < 120  # the rules of one in a hundred may share a literal
    took = []
    for index in (small, large):
        for p in paths:
            index.first(".txt", p)  # expressions are compiled
        start = time.perf_counter()
        assert sum(index.first(".txt", p) is not None for p in paths) >= 900
        took.append(time.perf_counter() - start)
    assert took[1] < 5 * took[0] + 0.05
