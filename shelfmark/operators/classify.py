"""First-match classification of files by an ordered rule table.

``classify`` compiles the rules to one CASE expression: no join and no shuffle, and the order of
the rules is that of the branches.  ``classify_by_table`` joins with rules held as data, and
``classify_by_index`` looks very many patterns up.  A rule matches if it has the file's (lower-cased) extension and, should it have patterns, one
matches the relative path; an empty list of patterns matches nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import Rule
from shelfmark.functions.globs import glob_regex
from shelfmark.functions.paths import extension, filename
from shelfmark.operators.pattern_index import classify_by_index

#: From this many rules on the join with a rule table is preferred, from this many patterns on their index.
MANY_RULES = 200
#: A rule table of up to this many (extension, rule) rows is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 100_000


def matches(rule: Rule, ext: Column, rel_path: Column) -> Column:
    hit = ext.isin(*rule.extensions) if rule.extensions else F.lit(False)
    if rule.patterns is None:
        return hit
    return hit & reduce(lambda a, b: a | b, [rel_path.rlike(glob_regex(p)) for p in rule.patterns], F.lit(False))


def first_match(rules: Sequence[Rule], ext: Column, rel_path: Column, value: str) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = getattr(rule, value)
        out = F.when(matches(rule, ext, rel_path), F.lit(found).cast("string")).otherwise(out)
    return out


def with_names(files: DataFrame) -> DataFrame:
    """Add ``filename`` and ``extension`` of ``rel_path``."""
    name = filename(F.col("rel_path"))
    return files.withColumns({"filename": name, "extension": extension(name)})


def classify(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``category`` and ``target_folder`` (null where no rule matches)."""
    if sum(len(r.patterns or ()) for r in rules) >= MANY_RULES:
        return classify_by_index(files, rules)
    if len(rules) >= MANY_RULES:
        return classify_by_table(files, rule_table(files.sparkSession, rules))
    ext, path = F.col("extension"), F.col("rel_path")
    return files.withColumns({
        "category": first_match(rules, ext, path, "name"),
        "target_folder": first_match(rules, ext, path, "target_folder"),
    })


RULES = "rule_ord int, name string, extensions array<string>, patterns array<string>, target_folder string"


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (i, r.name, list(r.extensions), None if r.patterns is None else [glob_regex(p) for p in r.patterns], r.target_folder)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES)


def classify_by_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with rules as rows (``patterns`` as regular expressions).

    Rules are folded to one row per extension - an array in their order - so a file meets at
    most one row and no file is multiplied; the first rule of the array that matches is taken.
    """
    flat = rules.select("rule_ord", "name", "target_folder", "patterns", F.explode("extensions").alias("__ext")).distinct()
    row = F.struct("rule_ord", "name", "target_folder", "patterns")
    by_ext = flat.groupBy("__ext").agg(F.array_sort(F.collect_list(row)).alias("__rules"))
    few = by_ext.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = files.join(F.broadcast(by_ext) if few else by_ext, F.col("extension") == F.col("__ext"), "left")

    def fits(rule: Column) -> Column:
        return rule["patterns"].isNull() | F.exists(rule["patterns"], lambda p: F.regexp_like(F.col("rel_path"), p))

    hit = F.element_at(F.filter(F.coalesce("__rules", F.array().cast("array<struct<rule_ord:int,name:string,target_folder:string,patterns:array<string>>>")), fits), 1)
    safe = F.when(F.size(F.filter(F.col("__rules"), fits)) > 0, hit)
    return met.withColumn("__hit", safe).withColumns(
        {"category": F.col("__hit.name"), "target_folder": F.col("__hit.target_folder")}
    ).drop("__ext", "__rules", "__hit")
