"""Registered queries over the driver's tables, each with SQL for the same result.

None of the tables is a listing, so ``part`` is read as one: type and key are folders, names
repeat (collisions) and have spaces (renames), extensions vary in case.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import CAMEL, KEBAB, PASCAL, SNAKE, Config, NamingConvention, Rule
from shelfmark.functions import guards, naming, paths
from shelfmark.operators import conflicts, logs, manifest, planning, summary
from shelfmark.operators.classify import classify, classify_by_table, rule_table, with_names
from shelfmark.operators.execution import execute
from shelfmark.operators.existence import PathTable
from shelfmark.sinks import documents, rows
from shelfmark.sources.inventory import excluded, hidden, listing, scan
from shelfmark.sources import json_stream
from shelfmark.sources.json_text import safe_parse, safe_parsed
from shelfmark.sinks.files import make_files, remove_files, save_manifest, save_markdown
from shelfmark.sinks.lines import committed, read_lines
from shelfmark.streaming import changes
from shelfmark.streaming.conflicts import ConflictStream
from shelfmark.tables import mounted, scratch, staged

BASE = "/base"
EXTENSIONS = (".jpg", ".PDF", ".txt", ".Ts", ".csv", ".zip", ".mp3", ".pptx", ".xyz", "", ".MD", ".tar.gz")
STAMP = "2024-01-01T00:00:00.000Z"
CONFIG = Config()
STYLES = {"kebab": KEBAB, "snake": SNAKE, "camel": CAMEL, "pascal": PASCAL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    rel = F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"), "p_name", ext)
    files = part.select(
        F.col("p_partkey").alias("scan_index"), rel.alias("rel_path"), F.concat(F.lit(BASE + "/"), rel).alias("original_path"),
        (F.col("p_retailprice") * 100).cast("bigint").alias("size"),
    )
    return with_names(files)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(inventory(spark, sf_dir), CONFIG.categories)


def operations(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> DataFrame:
    return planning.plan_operations(classified(spark, sf_dir), config, BASE)


def planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Staged operations, and the paths at the start: all files, and targets that are taken already.

    Both read the staged table, so the naming chain is evaluated once.
    """
    ops = staged(operations(spark, sf_dir), "planned")
    taken = ops.where("scan_index % 97 = 0").select(F.col("new_path").alias("path"))
    return ops, inventory(spark, sf_dir).select(F.col("original_path").alias("path")).unionByName(taken)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.resolve_conflicts(*planned(spark, sf_dir), is_staged=True)


# --- SQL for the same -------------------------------------------------------------------------


def ext_sql(n: str) -> str:
    return rf"lower(regexp_extract({n}, '(?s)^.+(\.[^.]*)$', 1))"


def stem_sql(n: str) -> str:
    return f"left({n}, length({n}) - length({ext_sql(n)}))"


def style_sql(x: str, style: str) -> str:
    if style == "kebab":
        return rf"lower(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1-\2', 'g'), '[\s_]+', '-', 'g'), '[^a-zA-Z0-9-]', '', 'g'))"
    if style == "snake":
        return rf"lower(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1_\2', 'g'), '[\s-]+', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g'))"
    words = rf"string_split_regex(lower({x}), '[-_\s]+')"
    up = "upper(w[1:1]) || w[2:]"
    camel = f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i = 1 THEN w ELSE {up} END), '')"
    return camel if style == "camel" else f"(upper(({camel})[1:1]) || ({camel})[2:])"


def named_sql(n: str, style: str) -> str:
    return f"{style_sql(stem_sql(n), style)} || {ext_sql(n)}"


_EXT_LIST = ", ".join(f"'{e}'" for e in EXTENSIONS)
INV = f"""inv AS (
  SELECT *, '{BASE}/' || rel_path AS original_path, {ext_sql("filename")} AS extension FROM (
    SELECT *, regexp_extract(rel_path, '[^/]*$') AS filename FROM (
      SELECT p_partkey AS scan_index, p_type || '/' || p_partkey || '/' || p_name || ([{_EXT_LIST}])[CAST(p_partkey % {len(EXTENSIONS)} AS INT) + 1] AS rel_path,
             CAST(trunc(p_retailprice * 100) AS BIGINT) AS size FROM part)))"""
_RULES = ", ".join(f"({i}, '{r.name}', '{e}')" for i, r in enumerate(CONFIG.categories) for e in r.extensions)
CLASSIFIED = f"""{INV}, rules(ord, name, ext) AS (VALUES {_RULES}),
files AS (SELECT i.*, m.category, m.category AS target_folder FROM inv i LEFT JOIN (
  SELECT scan_index, arg_min(name, ord) AS category FROM inv JOIN rules ON extension = ext GROUP BY 1) m USING (scan_index))"""


def ops_sql(style: str = "kebab", root: str = BASE) -> str:
    name = named_sql("filename", style)
    return f"""{CLASSIFIED}, named AS (SELECT *, {name} AS new_name FROM files),
placed AS (SELECT *, CASE WHEN target_folder IS NOT NULL THEN '{root}/' || target_folder ELSE regexp_replace(original_path, '/[^/]*$', '') END || '/' || new_name AS new_path FROM named),
ops AS (SELECT scan_index,
  CASE WHEN target_folder IS NOT NULL AND filename <> new_name THEN 'move-rename' WHEN target_folder IS NOT NULL THEN 'move' ELSE 'rename' END AS type,
  original_path, new_path,
  CASE WHEN target_folder IS NOT NULL AND filename <> new_name THEN 'Moving to ' || target_folder || ' and renaming to ' || new_name
       WHEN target_folder IS NOT NULL THEN 'Moving to ' || target_folder ELSE 'Renaming to ' || new_name END AS reason
  FROM placed WHERE new_path <> original_path)"""


RESOLVE = """k AS (SELECT o.scan_index, o.new_path, s.scan_index AS k FROM ops o LEFT JOIN ops s ON s.original_path = o.new_path),
cand AS (SELECT new_path, min(scan_index) AS scan_index, any_value(k) AS k FROM k WHERE k IS NULL OR scan_index > k GROUP BY new_path),
ok AS (SELECT scan_index FROM cand WHERE k IS NULL AND new_path NOT IN (SELECT path FROM present)
  UNION ALL SELECT c.scan_index FROM cand c JOIN ok ON c.k = ok.scan_index),
results AS (SELECT o.*, CASE WHEN ok.scan_index IS NULL THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN ok.scan_index IS NULL THEN 'Target file already exists: ' || new_path END AS error
  FROM ops o LEFT JOIN ok USING (scan_index))"""
PRESENT = "present AS (SELECT original_path AS path FROM inv UNION ALL SELECT new_path FROM ops WHERE scan_index % 97 = 0)"
RESULTS = f"WITH RECURSIVE {ops_sql()}, {PRESENT}, {RESOLVE}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# --- functions --------------------------------------------------------------------------------


@query("extension_extract", f"WITH {INV} SELECT scan_index, filename, extension FROM inv")
def extension_extract(spark, sf_dir):
    return inventory(spark, sf_dir).select("scan_index", "filename", "extension")


@query("filename_extract", f"""WITH {INV} SELECT scan_index, filename, {stem_sql("filename")} AS stem,
  regexp_replace(original_path, '/[^/]*$', '') AS dirname FROM inv""")
def filename_extract(spark, sf_dir):
    return inventory(spark, sf_dir).select(
        "scan_index", "filename", paths.stem(F.col("filename")).alias("stem"), paths.dirname(F.col("original_path")).alias("dirname")
    )


@query("original_path_join", f"WITH {INV} SELECT scan_index, original_path FROM inv")
def original_path_join(spark, sf_dir):
    joined = paths.join("/base/./x/..", F.concat(F.lit("./"), "rel_path"))
    return inventory(spark, sf_dir).select("scan_index", joined.alias("original_path"))


def _style_queries(style: str, convention: str) -> None:
    build = naming.STYLES[convention]

    @query(f"name_{style}", f"""SELECT 'part' AS kind, CAST(p_partkey AS BIGINT) AS id, {style_sql("p_name", style)} AS name, {style_sql("p_brand", style)} AS other FROM part
UNION ALL SELECT 'orders', o_orderkey, {style_sql("o_orderpriority", style)}, {style_sql("o_orderstatus", style)} FROM orders""")
    def styled(spark, sf_dir):
        part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
        return part.select(
            F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), build(F.col("p_name")).alias("name"), build(F.col("p_brand")).alias("other")
        ).unionByName(orders.select(
            F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"), build(F.col("o_orderpriority")).alias("name"), build(F.col("o_orderstatus")).alias("other")
        ))

    @query(f"apply_naming_{style}", f"""WITH {INV} SELECT scan_index, {named_sql("filename", style)} AS new_name,
  filename <> {named_sql("filename", style)} AS needs_rename FROM inv""")
    def applied(spark, sf_dir):
        c, name = NamingConvention(convention), F.col("filename")
        return inventory(spark, sf_dir).select(
            "scan_index", naming.apply_convention(name, c).alias("new_name"), naming.needs_rename(name, c).alias("needs_rename")
        )


for _style, _convention in STYLES.items():
    _style_queries(_style, _convention)


@query("apply_naming_unknown", f"WITH {INV} SELECT scan_index, lower(filename) AS lowered, {stem_sql('filename')} || extension AS kept FROM inv")
def apply_naming_unknown(spark, sf_dir):
    name = F.col("filename")
    return inventory(spark, sf_dir).select(
        "scan_index", naming.apply_convention(name, NamingConvention("other", True)).alias("lowered"),
        naming.apply_convention(name, NamingConvention("other", False)).alias("kept"),
    )


@query("iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def iso_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", manifest.iso(F.col("ts")).alias("iso"))


# --- classification and filters ---------------------------------------------------------------

_FILES = f"WITH {CLASSIFIED} SELECT scan_index, rel_path, category, target_folder FROM files"


@query("classify_first_match", _FILES)
def classify_first_match(spark, sf_dir):
    return classified(spark, sf_dir).select("scan_index", "rel_path", "category", "target_folder")


@query("classify_rule_join", _FILES)
def classify_rule_join(spark, sf_dir):
    files = classify_by_table(inventory(spark, sf_dir), rule_table(spark, CONFIG.categories))
    return files.select("scan_index", "rel_path", "category", "target_folder")


PATTERN_RULES = (
    Rule("first", (".txt", ".pdf"), ("*/1*/*", "*/2*/*"), "texts"), Rule("second", (".txt", ".jpg"), None, None),
    Rule("never", (".csv",), (), "never"), Rule("third", (".csv", ".JPG"), ("**/*a*.csv",), "sheets"),
)


@query("classify_with_patterns", rf"""WITH {INV} SELECT scan_index, CASE
  WHEN extension IN ('.txt', '.pdf') AND regexp_matches(rel_path, '^[^/.][^/]*/[12][^/]*/[^/.][^/]*$') THEN 'first'
  WHEN extension IN ('.txt', '.jpg') THEN 'second'
  WHEN extension = '.csv' AND regexp_matches(regexp_extract(rel_path, '[^/]*$'), '^[^.].*\.csv$') AND contains(left(filename, length(filename) - 4), 'a') THEN 'third' END AS category
FROM inv""")
def classify_with_patterns(spark, sf_dir):
    return classify(inventory(spark, sf_dir), PATTERN_RULES).select("scan_index", "category")


@query("classify_table_patterns", SQL["classify_with_patterns"])
def classify_table_patterns(spark, sf_dir):
    return classify_by_table(inventory(spark, sf_dir), rule_table(spark, PATTERN_RULES)).select("scan_index", "category")


#: One rule for each key, and one of each hundred for ranges of keys.
MANY = tuple(
    Rule(f"part{k}", (".txt", ".pdf", ".jpg", ".csv", ".md"), (f"*/{k}[0-9]/*", f"**/{k}??/*a*") if k % 100 == 0 else (f"*/{k}/*",), None if k % 5 == 0 else f"f{k % 7}")
    for k in range(10_000)
)


@query("classify_pattern_index", rf"""WITH {INV}, first AS (SELECT *, CASE WHEN extension IN ('.txt', '.pdf', '.jpg', '.csv', '.md') THEN least(
  CASE WHEN scan_index < 10000 AND scan_index % 100 <> 0 THEN scan_index END,
  CASE WHEN scan_index // 10 BETWEEN 1 AND 9999 AND (scan_index // 10) % 100 = 0 THEN scan_index // 10 END,
  CASE WHEN scan_index // 100 BETWEEN 1 AND 9999 AND (scan_index // 100) % 100 = 0 AND contains(filename, 'a') THEN scan_index // 100 END) END AS k FROM inv)
SELECT scan_index, 'part' || k AS category, CASE WHEN k % 5 <> 0 THEN 'f' || (k % 7) END AS target_folder FROM first""")
def classify_pattern_index(spark, sf_dir):
    """10,000 rules with patterns."""
    return classify(inventory(spark, sf_dir), MANY).select("scan_index", "category", "target_folder")


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^https?://[^/]*/", "")
    prefix = F.when(F.col("page_id") % 7 == 0, ".cache/").when(F.col("page_id") % 5 == 0, "dist/").when(F.col("page_id") % 3 == 0, "lib/dist/").otherwise("")
    return pages.select("page_id", F.concat(prefix, bare).alias("rel_path"))


_URLS = """urls AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '.cache/' WHEN page_id % 5 = 0 THEN 'dist/' WHEN page_id % 3 = 0 THEN 'lib/dist/' ELSE '' END
  || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*/', '') AS rel_path FROM pages)"""


@query("hidden_filter", rf"WITH {_URLS} SELECT page_id, rel_path FROM urls WHERE NOT regexp_matches(rel_path, '(^|/)\.')")
def hidden_filter(spark, sf_dir):
    return url_paths(spark, sf_dir).where(~hidden(F.col("rel_path")))


@query("exclude_filter", rf"WITH {_URLS} SELECT page_id, rel_path FROM urls WHERE NOT regexp_matches(rel_path, '^dist/.+') AND NOT regexp_matches(rel_path, '^en/[^/]+\.html$')")
def exclude_filter(spark, sf_dir):
    return url_paths(spark, sf_dir).where(~excluded(F.col("rel_path"), ("dist/**", "en/*.html")))


@query("existence_probe", f"WITH {ops_sql()}, {PRESENT} SELECT scan_index, new_path IN (SELECT path FROM present) AS target_exists FROM ops")
def existence_probe(spark, sf_dir):
    ops, there = planned(spark, sf_dir)
    return conflicts.with_target_exists(ops, there).select("scan_index", "target_exists")


# --- files on disk ----------------------------------------------------------------------------


def tree(spark: SparkSession, files: DataFrame, name: str) -> str:
    """A new folder with files (rel_path, size), which tasks write."""
    root = mounted(scratch(spark, name))
    os.makedirs(root)
    make_files(files, root)
    return root


def nation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each of the 25 nations, a hidden and an excluded one."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("n_nationkey") % len(EXTENSIONS) + 1).cast("int"))
    rel = F.concat("n_regionkey", F.lit("/deep/"), "n_name", ext)
    files = table(spark, sf_dir, "nation").select(rel.alias("rel_path"), (F.col("n_nationkey") * 7).cast("bigint").alias("size"))
    return files.unionByName(spark.createDataFrame([(".hidden/x.txt", 1), ("node_modules/y.txt", 1)], "rel_path string, size bigint"))


_TREE = f"""tree AS (SELECT *, regexp_extract(rel_path, '[^/]*$') AS filename, {ext_sql("rel_path")} AS extension FROM (
  SELECT n_regionkey || '/deep/' || n_name || ([{_EXT_LIST}])[CAST(n_nationkey % {len(EXTENSIONS)} AS INT) + 1] AS rel_path, CAST(n_nationkey * 7 AS BIGINT) AS size FROM nation)),
rules(ord, name, ext) AS (VALUES {_RULES}),
scanned AS (SELECT t.*, category, category AS target_folder, {named_sql("filename", "kebab")} AS suggested_name FROM tree t LEFT JOIN (
  SELECT rel_path AS p, arg_min(name, ord) AS category FROM tree JOIN rules ON extension = ext GROUP BY 1) ON p = rel_path)"""


@query("scan_tree", f"WITH {_TREE} SELECT rel_path, filename, extension, size, category, target_folder, suggested_name, filename <> suggested_name AS needs_rename FROM scanned")
def scan_tree(spark, sf_dir):
    files = scan(spark, tree(spark, nation_files(spark, sf_dir), "tree"), CONFIG)
    return files.select("rel_path", "filename", "extension", "size", "category", "target_folder", "suggested_name", "needs_rename")


_MOVED = f"""{_TREE}, moved AS (SELECT *, CASE WHEN category IS NULL THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE category END || '/' || suggested_name AS new_path FROM scanned)"""


@query("execute_tree", f"""WITH {_MOVED}
SELECT rel_path AS source, new_path AS target, 'success' AS status, size FROM moved WHERE new_path <> rel_path""")
def execute_tree(spark, sf_dir):
    """Scan, plan, rename the files, and list where they are now."""
    root = tree(spark, nation_files(spark, sf_dir), "tree")
    done = staged(execute(planning.plan_operations(scan(spark, root, CONFIG), CONFIG, root)), "done")
    below = [F.substring(c, len(root) + 2, 1 << 20).alias(n) for c, n in (("original_path", "source"), ("new_path", "target"))]
    now = listing(spark, root).where("is_file").select(F.col("rel_path").alias("target"), "size")
    return done.select(*below, "status").join(now, "target")


@query("execute_failing", """WITH f AS (SELECT p_partkey AS k, 'in' || p_partkey % 5 || '/' || p_partkey || '.txt' AS source, 'out/' || p_partkey // 7 || '.txt' AS target FROM part),
o AS (SELECT *, k % 11 = 0 AS missing, k // 7 % 13 = 0 AS taken FROM f),
w AS (SELECT target, min(k) FILTER (NOT missing AND NOT taken) AS winner FROM o GROUP BY target)
SELECT k AS scan_index, target, CASE WHEN k = winner THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN k = winner THEN 'none' WHEN missing AND NOT taken AND (winner IS NULL OR k < winner) THEN 'rename' ELSE 'conflict' END AS cause FROM o JOIN w USING (target)""")
def execute_failing(spark, sf_dir):
    """Renames in tasks of which some fail: sources that are gone, targets that are taken; others get their turn."""
    key = F.col("p_partkey")
    source = F.concat(F.lit("in"), (key % 5).cast("string"), F.lit("/"), key.cast("string"), F.lit(".txt"))
    target = F.concat(F.lit("out/"), F.expr("p_partkey div 7").cast("string"), F.lit(".txt"))
    plan = staged(table(spark, sf_dir, "part").select(key.alias("scan_index"), source.alias("source"), target.alias("target")), "moves")
    taken = plan.where("scan_index div 7 % 13 = 0").select(F.col("target").alias("rel_path")).distinct()
    files = plan.where("scan_index % 11 <> 0").select(F.col("source").alias("rel_path")).unionByName(taken)
    root = tree(spark, files.withColumn("size", F.lit(1).cast("bigint")), "failing")
    ops = plan.select("scan_index", F.lit("move").alias("type"), *[F.concat(F.lit(root + "/"), c).alias(n) for c, n in (("source", "original_path"), ("target", "new_path"))], F.lit("").alias("reason"))
    cause = F.when(F.col("error").isNull(), "none").when(F.startswith("error", F.lit(conflicts.CONFLICT)), "conflict").otherwise("rename")
    return execute(ops).select("scan_index", F.substring("new_path", len(root) + 2, 1 << 20).alias("target"), "status", cause.alias("cause"))


@query("existence_table", f"WITH {ops_sql()}, {PRESENT} SELECT scan_index, new_path IN (SELECT path FROM present) AS target_exists FROM ops")
def existence_table(spark, sf_dir):
    """The probe against a stored path table, of which target folders are read."""
    ops, there = planned(spark, sf_dir)
    near = PathTable(spark, scratch(spark, "paths")).write(there).near(ops)
    return conflicts.with_target_exists(ops, near).select("scan_index", "target_exists")


@query("scan_changes", """WITH f AS (SELECT 'd' || p_partkey % 20 || '/' || p_partkey || '.txt' AS rel_path, p_partkey AS k FROM part)
SELECT CAST(1 AS BIGINT) AS version, 'added' AS kind, 1 AS sign, rel_path, CAST(5 AS BIGINT) AS size FROM f WHERE k % 3 <> 0
UNION ALL SELECT 2, 'added', 1, rel_path, 5 FROM f WHERE k % 3 = 0
UNION ALL SELECT 2, 'gone', -1, rel_path, 5 FROM f WHERE k % 3 = 1 AND k % 5 = 0
UNION ALL SELECT 2, 'changed', sign, rel_path, CASE sign WHEN 1 THEN 9 ELSE 5 END FROM f, (VALUES (1), (-1)) s(sign) WHERE k % 3 = 2 AND k % 7 = 0""")
def scan_changes(spark, sf_dir):
    """Two scans of a tree that changes in between, as signed rows of a stream."""
    key = F.col("p_partkey")
    path = F.concat(F.lit("d"), (key % 20).cast("string"), F.lit("/"), key.cast("string"), F.lit(".txt"))
    files = table(spark, sf_dir, "part").select(path.alias("rel_path"), key.alias("k"), F.lit(5).cast("bigint").alias("size"))
    state, root = scratch(spark, "watch"), tree(spark, files.where("k % 3 <> 0"), "changing")
    watch = changes.Watch(spark, root, state)
    watch.poll()
    make_files(files.where("k % 3 = 0").unionByName(files.where("k % 3 = 2 AND k % 7 = 0").withColumn("size", F.lit(9).cast("bigint"))), root)
    remove_files(files.where("k % 3 = 1 AND k % 5 = 0"), root)
    watch.poll()
    out = scratch(spark, "changes")
    stream = changes.changes(spark, state).where("is_file").select("version", "kind", "sign", "rel_path", "size").writeStream.format("parquet")
    stream.option("path", out).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("version bigint, kind string, sign int, rel_path string, size bigint").parquet(out)


# --- planning, execution, counts --------------------------------------------------------------


@query("category_summary", f"""WITH {CLASSIFIED} SELECT coalesce(nullif(category, ''), 'uncategorized') AS category, count(*) AS n, min(scan_index) AS first_index FROM files GROUP BY 1""")
def category_summary(spark, sf_dir):
    return summary.category_summary(classified(spark, sf_dir))


@query("plan_operations", f"WITH {ops_sql()} SELECT * FROM ops")
def plan_operations(spark, sf_dir):
    return operations(spark, sf_dir)


@query("plan_with_target_dir", f"WITH {ops_sql('pascal', '/output')} SELECT * FROM ops")
def plan_with_target_dir(spark, sf_dir):
    return operations(spark, sf_dir, Config(target_directory="/output/", naming_convention=NamingConvention(PASCAL)))


@query("operation_type_counts", f"""WITH {ops_sql()} SELECT t.type, count(ops.scan_index) AS n
FROM (VALUES ('move'), ('rename'), ('move-rename')) t(type) LEFT JOIN ops ON ops.type = t.type GROUP BY 1""")
def operation_type_counts(spark, sf_dir):
    return summary.operation_type_counts(operations(spark, sf_dir))


@query("scan_report", f"""WITH {ops_sql()} SELECT 'category' AS kind, coalesce(category, 'uncategorized') AS label, count(*) AS n FROM files GROUP BY ALL
UNION ALL SELECT 'operation', t.type, count(ops.scan_index) FROM (VALUES ('move'), ('rename'), ('move-rename')) t(type) LEFT JOIN ops ON ops.type = t.type GROUP BY ALL""")
def scan_report(spark, sf_dir):
    """The flagship: scan, classify, plan, count."""
    files = classified(spark, sf_dir)
    by_category = summary.category_summary(files).select(F.lit("category").alias("kind"), F.col("category").alias("label"), "n")
    by_type = summary.operation_type_counts(planning.plan_operations(files, CONFIG, BASE))
    return by_category.unionByName(by_type.select(F.lit("operation").alias("kind"), F.col("type").alias("label"), "n"))


@query("dry_run_result", f"WITH {ops_sql()} SELECT *, 'success' AS status, CAST(NULL AS VARCHAR) AS error FROM ops")
def dry_run_result(spark, sf_dir):
    return conflicts.dry_run(operations(spark, sf_dir))


@query("resolve_conflicts", f"{RESULTS} SELECT * FROM results")
def resolve_conflicts(spark, sf_dir):
    return results(spark, sf_dir)


@query("execution_counts", f"""{RESULTS} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed FROM results""")
def execution_counts(spark, sf_dir):
    return summary.outcome_counts(results(spark, sf_dir))


@query("collected_errors", f"{RESULTS} SELECT scan_index AS error_index, original_path AS file, error FROM results WHERE status = 'failed'")
def collected_errors(spark, sf_dir):
    return summary.errors(results(spark, sf_dir))


# (case, index, source, target); paths on disk besides the sources.  Each part is one of the cases, or a link of a chain of 40.
CHAINS = (
    (1, 0, "x/A", "d/a"), (1, 1, "y/A", "d/a"), (2, 0, "x/A", "d/a"), (3, 0, "p", "q"), (3, 1, "r", "p"), (4, 0, "r", "p"), (4, 1, "p", "q"),
    (5, 0, "p", "q"), (5, 1, "r", "p"), (6, 0, "r", "p"), (6, 1, "p", "q"), (6, 2, "s", "p"),
)
TAKEN = ((2, "d/a"), (5, "q"))
_CASES = ", ".join(map(str, CHAINS))
_LINK = "CAST(p_partkey // 280 AS VARCHAR) || '/' || CAST(p_partkey // 7 % 40 {} AS VARCHAR)"
_CHAINED = f"""ops AS (SELECT p_partkey * 10 + i AS scan_index, 'move' AS type, '/b' || p_partkey || '/' || s AS original_path, '/b' || p_partkey || '/' || t AS new_path, 'r' AS reason
  FROM part JOIN (VALUES {_CASES}) v(c, i, s, t) ON p_partkey % 7 = c
  UNION ALL SELECT p_partkey * 10, 'rename', '/c' || {_LINK.format("")}, '/c' || {_LINK.format("- 1")}, 'r' FROM part WHERE p_partkey % 7 = 0),
present AS (SELECT original_path AS path FROM ops UNION ALL SELECT '/b' || p_partkey || '/' || t FROM part JOIN (VALUES {", ".join(map(str, TAKEN))}) v(c, t) ON p_partkey % 7 = c)"""


def chained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Operations that wait for each other, and the paths at the start."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    cases = F.broadcast(spark.createDataFrame(CHAINS, "c int, i int, s string, t string"))
    taken = F.broadcast(spark.createDataFrame(TAKEN, "c int, t string"))

    def path(prefix: str, *cols: Column) -> Column:
        return F.concat(F.lit(prefix), *[c.cast("string") for c in cols])

    at = [path("/b", F.col("k"), F.lit("/"), F.col(c)) for c in ("s", "t")]
    own = part.join(cases, F.col("k") % 7 == F.col("c")).select((F.col("k") * 10 + F.col("i")).alias("scan_index"), F.lit("move").alias("type"), at[0].alias("original_path"), at[1].alias("new_path"), F.lit("r").alias("reason"))
    link = F.expr("k div 7 % 40")
    links = [path("/c", F.expr("k div 280"), F.lit("/"), x) for x in (link, link - 1)]
    rest = part.where("k % 7 = 0").select((F.col("k") * 10).alias("scan_index"), F.lit("rename").alias("type"), links[0].alias("original_path"), links[1].alias("new_path"), F.lit("r").alias("reason"))
    ops = staged(own.unionByName(rest), "chained")
    there = part.join(taken, F.col("k") % 7 == F.col("c")).select(at[1].alias("path"))
    return ops, ops.select(F.col("original_path").alias("path")).unionByName(there)


@query("resolve_conflicts_chained", f"WITH RECURSIVE {_CHAINED}, {RESOLVE} SELECT scan_index, new_path, status, error FROM results")
def resolve_conflicts_chained(spark, sf_dir):
    return conflicts.resolve_conflicts(*chained(spark, sf_dir), is_staged=True).select("scan_index", "new_path", "status", "error")


@query("resolve_conflicts_stream", f"WITH RECURSIVE {_CHAINED}, {RESOLVE} SELECT scan_index, new_path, status, error FROM results WHERE type = 'move'")
def resolve_conflicts_stream(spark, sf_dir):
    """The operations (but for the long chains) in three batches, the last ones first."""
    ops, there = chained(spark, sf_dir)
    ops, path = ops.where("type = 'move'").select("scan_index", "original_path", "new_path"), scratch(spark, "ops")
    stream = ConflictStream(spark, scratch(spark, "stream"))
    stream.begin(there)
    for rest in (2, 1, 0):
        ops.where(F.col("scan_index") % 3 == rest).coalesce(1).write.mode("append").parquet(path)
    stream.drain(spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(path))
    return stream.outcomes()


# --- manifest, logs, text ---------------------------------------------------------------------

_ENTRIES = f"""{RESULTS}, errs AS (SELECT original_path AS file, arg_min(error, scan_index) AS err FROM results WHERE status = 'failed' GROUP BY 1),
entries AS (SELECT scan_index, '{STAMP}' AS timestamp, type, original_path, new_path, reason, CASE WHEN err IS NULL THEN 'success' ELSE 'failed' END AS status, err AS error
  FROM results r LEFT JOIN errs ON file = original_path)"""
_BLOCK = """'### ' || CASE status WHEN 'success' THEN '✓' ELSE '✗' END || ' ' || upper(type) || chr(10) || '- **From:** `' || original_path || '`' || chr(10)
  || '- **To:** `' || new_path || '`' || chr(10) || '- **Reason:** ' || reason || chr(10) || CASE WHEN error IS NULL THEN '' ELSE '- **Error:** ' || error || chr(10) END"""


def entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = results(spark, sf_dir)
    return manifest.entries(done, summary.errors(done), F.lit(STAMP))


@query("manifest_entries", f"{_ENTRIES} SELECT * FROM entries")
def manifest_entries(spark, sf_dir):
    return entry_rows(spark, sf_dir).select("scan_index", "timestamp", "operation.*", "status", "error")


@query("manifest_header", f"""{_ENTRIES} SELECT '{STAMP}' AS generated_at, count(*) AS total_operations, CAST(7 AS BIGINT) AS successful, CAST(3 AS BIGINT) AS failed, count(*) AS n_entries FROM entries""")
def manifest_header(spark, sf_dir):
    head = manifest.header(entry_rows(spark, sf_dir), 7, 3, STAMP)
    return head.withColumn("n_entries", F.col("total_operations"))


@query("manifest_markdown_blocks", f"{_ENTRIES} SELECT scan_index, {_BLOCK} AS block FROM entries")
def manifest_markdown_blocks(spark, sf_dir):
    return entry_rows(spark, sf_dir).select("scan_index", manifest.block(F.col("operation"), F.col("status"), F.col("error")).alias("block"))


_MARKDOWN_HEAD = f"""'# File Organization Manifest' || chr(10) || chr(10) || '**Generated:** {STAMP}' || chr(10) || chr(10)
  || '**Total Operations:** ' || (SELECT count(*) FROM entries) || chr(10) || '**Successful:** 7' || chr(10) || '**Failed:** 3' || chr(10) || chr(10) || '## Operations' || chr(10) || chr(10)"""
_JSON_HEAD = f"""'{{' || chr(10) || '  "generatedAt": "{STAMP}",' || chr(10) || '  "totalOperations": ' || (SELECT count(*) FROM entries) || ',' || chr(10) || '  "successful": 7,' || chr(10)
  || '  "failed": 3,' || chr(10) || '  "entries": [' || chr(10)"""
_JSON_BLOCK = """'    {' || chr(10) || '      "timestamp": ' || to_json(timestamp) || ',' || chr(10) || '      "operation": {' || chr(10) || '        "type": ' || to_json(type) || ',' || chr(10)
  || '        "originalPath": ' || to_json(original_path) || ',' || chr(10) || '        "newPath": ' || to_json(new_path) || ',' || chr(10) || '        "reason": ' || to_json(reason) || chr(10)
  || '      },' || chr(10) || '      "status": ' || to_json(status) || CASE WHEN error IS NULL THEN '' ELSE ',' || chr(10) || '      "error": ' || to_json(error) END || chr(10) || '    }'"""


def _chunks_sql(head: str, block: str, between: str, tail: str = "NULL") -> str:
    """(place, offset, chunk) of a document."""
    return f"""{_ENTRIES}, parts AS (SELECT 0 AS place, {head} AS chunk UNION ALL
  SELECT row_number() OVER (ORDER BY scan_index), CASE WHEN row_number() OVER (ORDER BY scan_index) > 1 THEN {between} ELSE '' END || {block} FROM entries
  UNION ALL SELECT (SELECT count(*) FROM entries) + 1, {tail}),
chunked AS (SELECT CAST(place AS BIGINT) AS place, CAST(coalesce(sum(strlen(chunk)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", chunk FROM parts WHERE chunk IS NOT NULL)"""


def made_manifest(spark: SparkSession, sf_dir: str) -> manifest.Manifest:
    return manifest.manifest(entry_rows(spark, sf_dir), 7, 3, STAMP)


@query("manifest_markdown", f"""{_chunks_sql(_MARKDOWN_HEAD, _BLOCK, "chr(10)")} SELECT * FROM chunked""")
def manifest_markdown(spark, sf_dir):
    """The document's chunks with their byte offsets."""
    return documents.chunks(manifest.markdown(made_manifest(spark, sf_dir)))[0]


@query("manifest_json", f"""{_chunks_sql(_JSON_HEAD, _JSON_BLOCK, "',' || chr(10)", "chr(10) || '  ]' || chr(10) || '}'")} SELECT * FROM chunked""")
def manifest_json(spark, sf_dir):
    return documents.chunks(manifest.json_document(made_manifest(spark, sf_dir)))[0]


@query("manifest_files", f"""{_chunks_sql(_JSON_HEAD, _JSON_BLOCK, "',' || chr(10)", "chr(10) || '  ]' || chr(10) || '}'")},
md AS (SELECT 0 AS scan_index, {_MARKDOWN_HEAD} || string_agg({_BLOCK}, chr(10) ORDER BY scan_index) AS text FROM entries),
whole AS (SELECT 'manifest.json' AS file, string_agg(chunk, '' ORDER BY place) || chr(10) AS text FROM chunked UNION ALL SELECT 'manifest.md', text FROM md)
SELECT file, unnest(string_split(left(text, length(text) - 1), chr(10))) AS line FROM whole""")
def manifest_files(spark, sf_dir):
    """Both documents as files that tasks write in place, read back line by line."""
    folder, made = scratch(spark, "manifests"), made_manifest(spark, sf_dir)
    save_manifest(made, f"{folder}/manifest.json")
    save_markdown(made, f"{folder}/manifest.md")
    return spark.read.option("lineSep", "\n").text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


_LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'debug' WHEN 'view' THEN 'info' WHEN 'signup' THEN 'warn' ELSE 'other' END"


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", manifest.iso(F.col("ts")).alias("timestamp"), F.expr(_LEVEL).alias("level"), F.col("event_type").alias("message"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '0' WHEN event_id % 5 = 2 THEN 'false' ELSE props END").alias("details"),
    )


_LOGS = f"""logs AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, {_LEVEL} AS level, event_type AS message,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '0' WHEN event_id % 5 = 2 THEN 'false' ELSE props END AS details FROM events)"""


@query("level_priority", f"WITH {_LOGS} SELECT event_id, CASE level WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'warn' THEN 2 WHEN 'error' THEN 3 END AS priority FROM logs")
def level_priority(spark, sf_dir):
    return event_logs(spark, sf_dir).select("event_id", logs.priority(F.col("level")).alias("priority"))


@query("log_threshold", f"WITH {_LOGS} SELECT event_id, level FROM logs WHERE level IN ('warn', 'error')")
def log_threshold(spark, sf_dir):
    return logs.at_threshold(event_logs(spark, sf_dir), "warn").select("event_id", "level")


@query("log_threshold_unknown", f"WITH {_LOGS} SELECT event_id, level FROM logs WHERE false")
def log_threshold_unknown(spark, sf_dir):
    return logs.at_threshold(event_logs(spark, sf_dir), "verbose").select("event_id", "level")


@query("log_lines", f"""WITH {_LOGS} SELECT event_id, timestamp || ' [' || upper(level) || '] ' || message
  || CASE WHEN details IS NULL OR details IN ('0', 'false') THEN '' ELSE ' ' || details END AS line FROM logs""")
def log_lines(spark, sf_dir):
    line = logs.line(F.col("timestamp"), F.col("level"), F.col("message"), F.col("details"))
    return event_logs(spark, sf_dir).select("event_id", line.alias("line"))


@query("csv_rows", """SELECT event_id, event_id || ',' || event_type || ',' || user_id || ',' || CASE WHEN contains(p, ',') THEN '"' || replace(p, '"', '""') || '"' ELSE p END || ',' AS line
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN replace(props, ',', ';') ELSE props END AS p FROM events)""")
def csv_rows(spark, sf_dir):
    data = csv_data(spark, sf_dir).withColumn("key", F.col("event_id"))
    return rows.csv_rows(data, "key").select(F.col("key").alias("event_id"), "line")


_CSV_SINK = """SELECT CAST(0 AS BIGINT) AS file_no, 'event_id,event_type,user_id,p,none' AS line UNION ALL SELECT CAST(1 AS BIGINT), line FROM ({})"""


def csv_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    p = F.when(F.col("event_id") % 3 == 0, F.replace("props", F.lit(","), F.lit(";"))).otherwise(F.col("props"))
    return events.select("event_id", "event_type", "user_id", p.alias("p"), F.lit(None).cast("string").alias("none"))


@query("csv_sink", _CSV_SINK.format(SQL["csv_rows"]))
def csv_sink(spark, sf_dir):
    """CSV files with one header, read back; ``file_no`` is 0 for the first file, which is the header's, else 1."""
    path = scratch(spark, "csv")
    rows.write_csv(csv_data(spark, sf_dir), path, ("event_id",))
    first = committed(path)[0].rpartition("/")[2]
    return read_lines(spark, path).select((F.col("file") != first).cast("bigint").alias("file_no"), "line")


@query("log_sink", f"""SELECT line FROM ({SQL["log_lines"]}) WHERE event_id % 2 = 0 UNION ALL SELECT line FROM ({SQL["log_lines"]}) WHERE event_id % 2 = 1""")
def log_sink(spark, sf_dir):
    """Log lines appended to files twice, read back."""
    path = scratch(spark, "log")
    for rest in (0, 1):
        rows.append_text(log_lines(spark, sf_dir).where(F.col("event_id") % 2 == rest).select("line"), path)
    return read_lines(spark, path).select("line")


@query("json_sink", """WITH j AS (SELECT row_number() OVER (ORDER BY event_id) AS n, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS t FROM events)
SELECT CASE WHEN n = 1 THEN '[' ELSE '' END || t || CASE WHEN n = (SELECT count(*) FROM events) THEN ']' ELSE ',' END AS line FROM j""")
def json_sink(spark, sf_dir):
    """All events as one JSON array in one file, read back in pieces that end before a ``{``."""
    path = scratch(spark, "json")
    documents.save(rows.json_array(table(spark, sf_dir, "events").select("event_id", "event_type"), ("event_id",)), f"{path}/events.json")
    pieces = spark.read.option("lineSep", "},").text(path).select(F.col("value"))
    return pieces.select(F.when(F.endswith("value", F.lit("]")), F.col("value")).otherwise(F.concat("value", F.lit("},"))).alias("line"))


@query("table_rows", "SELECT event_id, '- ' || event_type AS line FROM events")
def table_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rows.table_rows(F.col("event_type")).alias("line"))


@query("json_rows", """SELECT event_id AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"user_id":' || user_id ELSE '' END || '}' AS line FROM events""")
def json_rows(spark, sf_dir):
    user = F.when(F.col("event_id") % 2 == 0, F.col("user_id"))
    return rows.json_rows(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "event_id", "event_type", user.alias("user_id")), "key")


@query("json_safe_parse", """SELECT event_id, json_valid(CASE WHEN event_id % 10 = 0 THEN '{bad' ELSE props END) AS parsed FROM events""")
def json_safe_parse(spark, sf_dir):
    text = F.when(F.col("event_id") % 10 == 0, "{bad").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", safe_parse(text).isNotNull().alias("parsed"))


@query("json_files", """SELECT place, chunk AS pointer, kind, value FROM (SELECT event_id - (SELECT min(event_id) FROM events) AS place, '/' || (event_id - (SELECT min(event_id) FROM events)) || '/' || k AS chunk,
  CASE k WHEN 'event_id' THEN 'number' ELSE 'string' END AS kind, CASE k WHEN 'event_id' THEN CAST(event_id AS VARCHAR) ELSE props END AS value FROM events, (VALUES ('event_id'), ('props')) v(k))
UNION ALL SELECT NULL, NULL, 'error', 'a comma or ] was expected'""")
def json_files(spark, sf_dir):
    """All events as one large JSON file, read back as rows of pointers; and one that breaks off."""
    path, events = scratch(spark, "json"), table(spark, sf_dir, "events").select("event_id", "props")
    documents.save(rows.json_array(events, ("event_id",)), f"{path}/all.json")
    documents.save(documents.Document(events.limit(1).select("event_id", F.lit("1").alias("block")), ("event_id",), "[", "", " 2]"), f"{path}/broken.json")
    files = spark.createDataFrame([(f"{path}/all.json",), (f"{path}/broken.json",)], "file string")
    found = json_stream.read_json(spark, files.repartition(2)).where("kind <> 'error' OR offset = 3").where("NOT (file LIKE '%broken.json' AND kind = 'number')")
    return found.select(F.split_part("pointer", F.lit("/"), F.lit(2)).cast("bigint").alias("place"), "pointer", "kind", "value")


@query("json_parse_log", """SELECT event_id, 'warn' AS level, 'Failed to parse JSON string' AS message, '{bad' AS details FROM events WHERE event_id % 10 = 0""")
def json_parse_log(spark, sf_dir):
    """What a safe parse logs."""
    text = F.when(F.col("event_id") % 10 == 0, "{bad").otherwise(F.col("props"))
    _, log = safe_parsed(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", "event_id")
    return log


_VALUES_BY = "CASE event_id % 7 WHEN 0 THEN '{\"a\":1}' WHEN 1 THEN '\"x\"' WHEN 2 THEN '1.5' WHEN 3 THEN '7' WHEN 4 THEN 'true' WHEN 5 THEN '[1,\"a\"]' ELSE 'null' END"


@query("type_guards", f"""SELECT event_id, t = 'OBJECT' AS is_object, t = 'VARCHAR' AS is_string, t IN ('DOUBLE', 'BIGINT', 'UBIGINT') AS is_number, t = 'BOOLEAN' AS is_boolean,
  t = 'ARRAY' AS is_array, t = 'NULL' AS is_null, t NOT IN ('OBJECT', 'ARRAY') AS is_primitive FROM (SELECT event_id, json_type({_VALUES_BY}) AS t FROM events)""")
def type_guards(spark, sf_dir):
    v = F.col("v")
    return table(spark, sf_dir, "events").select("event_id", F.parse_json(F.expr(_VALUES_BY)).alias("v")).select(
        "event_id", guards.is_object(v).alias("is_object"), guards.is_string(v).alias("is_string"), guards.is_number(v).alias("is_number"),
        guards.is_boolean(v).alias("is_boolean"), guards.is_array(v).alias("is_array"), guards.is_null_or_undefined(v).alias("is_null"),
        guards.is_primitive(v).alias("is_primitive"),
    )
