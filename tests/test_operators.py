import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.config import Config, NamingConvention, Rule
from shelfmark.operators import conflicts, logs, manifest, summary
from shelfmark.operators.classify import classify, classify_by_table, rule_table
from shelfmark.operators.planning import plan_operations
from shelfmark.sinks import documents, rows

RULES = (
    Rule("images", (".jpg", ".png"), None, "images"), Rule("documents", (".pdf", ".doc"), ("plan-*",), "documents"), Rule("code", (".ts", ".js"), None, "code"),
    Rule("late", (".pdf", ".zip"), (), None), Rule("upper", (".JPG",), None, "upper"),
)
FILES = [
    ("sunset.jpg", ".jpg", "images"), ("logo.png", ".png", "images"), ("file.ts", ".ts", "code"), ("file.xyz", ".xyz", None), ("plan-07.pdf", ".pdf", "documents"),
    ("bill.pdf", ".pdf", None), ("sub/plan-1.pdf", ".pdf", None), ("a.zip", ".zip", None),
]


@pytest.mark.parametrize("many", [False, True])
def test_classify(spark, many):
    files = spark.createDataFrame([(p, e) for p, e, _ in FILES], "rel_path string, extension string")
    got = classify_by_table(files, rule_table(spark, RULES)) if many else classify(files, RULES)
    assert {r.rel_path: r.category for r in got.collect()} == {p: c for p, _, c in FILES}
    assert classify(files, ()).where("category IS NOT NULL").count() == 0


def test_first_rule_wins(spark):
    rules = (Rule("a", (".x",), None, None), Rule("b", (".x",), None, "b"))
    files = spark.createDataFrame([("f.x", ".x")], "rel_path string, extension string")
    for got in (classify(files, rules), classify_by_table(files, rule_table(spark, rules))):
        assert tuple(got.select("category", "target_folder").first()) == ("a", None)


PLANS = [
    ("/base/dir/TestFile.txt", "documents", ("move-rename", "/base/dir/documents/test-file.txt", "Moving to documents and renaming to test-file.txt")),
    ("/base/dir/test-file.txt", "documents", ("move", "/base/dir/documents/test-file.txt", "Moving to documents")),
    ("/base/dir/TestFile.txt", None, ("rename", "/base/dir/test-file.txt", "Renaming to test-file.txt")),
    ("/base/dir/documents/test-file.txt", "documents", None),
    ("/base/dir/documents/TestFile.txt", "documents", ("move-rename", "/base/dir/documents/test-file.txt", "Moving to documents and renaming to test-file.txt")),
    ("/base/dir/sub/Notes", None, ("rename", "/base/dir/sub/notes", "Renaming to notes")),
    ("/base/dir/A.txt", "", ("move-rename", "/base/dir/a.txt", "Moving to  and renaming to a.txt")),
]


def test_plan(spark):
    data = [(i, p, p.rsplit("/", 1)[1], t) for i, (p, t, _) in enumerate(PLANS)]
    files = spark.createDataFrame(data, "scan_index bigint, original_path string, filename string, target_folder string")
    got = {r.scan_index: (r.type, r.new_path, r.reason) for r in plan_operations(files, Config(), "/base/dir").collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(PLANS) if e}
    out = plan_operations(files, Config(target_directory="/output/x/.."), "/base/dir").where("scan_index = 1").first()
    assert out.new_path == "/output/documents/test-file.txt"
    odd = Config(categories=(Rule("r", (".txt",), None, "../up//x"),))
    moved = files.where("scan_index = 1").withColumn("target_folder", F.lit("../up//x"))
    assert plan_operations(moved, odd, "/base/dir").first().new_path == "/base/up/x/test-file.txt"


def sequential(ops, there):
    disk, out = set(there), {}
    for i, source, target in sorted(ops):
        ok = target == source or target not in disk
        if ok:
            disk.discard(source)
            disk.add(target)
        out[i] = "success" if ok else "failed"
    return out


def test_conflicts_random(spark):
    """Many independent random cases at once, against literal sequential execution."""
    rng, ops, there, expected = random.Random(3), [], [], {}
    for case in range(150):
        names = [f"/{case}/{k}" for k in range(8)]
        sources = rng.sample(names, rng.randint(1, 6))
        own = [(case * 100 + i, s, rng.choice([n for n in names if n != s])) for i, s in enumerate(sources)]
        disk = set(sources) | {n for n in names if rng.random() < 0.2}
        expected |= sequential(own, disk)
        ops += own
        there += [(p,) for p in disk]
    df = spark.createDataFrame([(i, "move", s, t, "r") for i, s, t in ops], "scan_index bigint, type string, original_path string, new_path string, reason string")
    got = conflicts.resolve_conflicts(df, spark.createDataFrame(there, "path string"))
    assert {r.scan_index: r.status for r in got.collect()} == expected
    assert got.where("status = 'failed'").where(F.col("error") != F.concat(F.lit(conflicts.CONFLICT), "new_path")).count() == 0


def test_conflict_with_file_in_place_of_folder(spark):
    df = spark.createDataFrame([(0, "move", "/b/a", "/b/documents/a", "r")], "scan_index bigint, type string, original_path string, new_path string, reason string")
    there = spark.createDataFrame([("/b/a", True), ("/b/documents", True)], "path string, is_file boolean")
    assert conflicts.resolve_conflicts(df, there).first().error == conflicts.BLOCKED + "/b/documents"


def test_summary(spark):
    files = spark.createDataFrame([(0, "images"), (1, "images"), (2, None), (3, "")], "scan_index bigint, category string")
    assert [tuple(r) for r in summary.category_summary(files).orderBy("first_index").collect()] == [("images", 2, 0), ("uncategorized", 2, 2)]
    assert summary.category_summary(files.limit(0)).count() == 0
    ops = spark.createDataFrame([("move",), ("move",)], "type string")
    assert {r.type: r.n for r in summary.operation_type_counts(ops).collect()} == {"move": 2, "rename": 0, "move-rename": 0}


OPS = [
    (0, "move", "/source/file1.txt", "/target/file1.txt", "Moving to target"), (1, "move-rename", "/source/File2.txt", "/source/file-2.txt", "Renaming to kebab-case"),
]
OP_SCHEMA = "scan_index bigint, type string, original_path string, new_path string, reason string"


def whole(document):
    """A document's chunks, each at its offset."""
    rows, size = documents.chunks(document)
    out = bytearray(size)
    for r in rows.collect():
        out[r.offset : r.offset + len(r.chunk.encode())] = r.chunk.encode()
    assert len(out) == size
    return out.decode()


def test_manifest(spark):
    ops = spark.createDataFrame(OPS, OP_SCHEMA)
    errors = spark.createDataFrame([(1, "/source/file1.txt", "later"), (0, "/source/file1.txt", "File locked")], "error_index bigint, file string, error string")
    stamp = "2024-01-01T00:00:00.000Z"
    rows = manifest.entries(ops, errors, F.lit(stamp))
    document = manifest.manifest(rows, 1, 1, stamp)
    assert (document.total_operations, document.successful, document.failed) == (2, 1, 1)
    assert [(e.status, e.error) for e in document.entries.orderBy("scan_index").collect()] == [("failed", "File locked"), ("success", None)]
    assert whole(manifest.markdown(document, "T")) == (
        "# T\n\n**Generated:** 2024-01-01T00:00:00.000Z\n\n**Total Operations:** 2\n**Successful:** 1\n**Failed:** 1\n\n## Operations\n\n"
        "### ✗ MOVE\n- **From:** `/source/file1.txt`\n- **To:** `/target/file1.txt`\n- **Reason:** Moving to target\n- **Error:** File locked\n\n"
        "### ✓ MOVE-RENAME\n- **From:** `/source/File2.txt`\n- **To:** `/source/file-2.txt`\n- **Reason:** Renaming to kebab-case\n"
    )
    operations = [dict(zip(("type", "originalPath", "newPath", "reason"), o[1:], strict=True)) for o in OPS]
    expected = {"generatedAt": stamp, "totalOperations": 2, "successful": 1, "failed": 1, "entries": [
        {"timestamp": stamp, "operation": operations[0], "status": "failed", "error": "File locked"}, {"timestamp": stamp, "operation": operations[1], "status": "success"},
    ]}
    assert whole(manifest.json_document(document)) == json.dumps(expected, indent=2, ensure_ascii=False)
    empty = manifest.manifest(rows.limit(0), 0, 0, stamp)
    assert "## Operations" not in whole(manifest.markdown(empty))
    assert whole(manifest.json_document(empty)) == json.dumps(expected | {"totalOperations": 0, "successful": 0, "failed": 0, "entries": []}, indent=2)


def test_logs(spark):
    df = spark.createDataFrame([(x,) for x in ("debug", "info", "warn", "error", "other")], "level string")
    expected = {"debug": 4, "info": 3, "warn": 2, "error": 1, "verbose": 0}
    assert {k: logs.at_threshold(df, k).count() for k in expected} == expected
    details = spark.createDataFrame([(v,) for v in (None, "null", "0", '""', "false", '{"a":1}', "[]")], "d string")
    lines = [r.l for r in details.select(logs.line(F.lit("t"), F.lit("info"), F.lit("m"), F.col("d")).alias("l")).collect()]
    assert lines == ["t [INFO] m"] * 5 + ['t [INFO] m {"a":1}', "t [INFO] m []"]


def test_csv(spark):
    df = spark.createDataFrame([("p,q", 'say "hi", ok', None, True, (1,)), ("x", 'say "hi"', 1, None, None)], "a string, b string, c int, d boolean, e struct<k:int>")
    assert rows.csv_header(df) == "a,b,c,d,e"
    assert [r.line for r in rows.csv_rows(df).collect()] == ['"p,q","say ""hi"", ok",,true,{"k":1}', 'x,say "hi",1,,']
    assert [r.line for r in rows.json_rows(df.select("a", "c")).collect()] == ['{"a":"p,q"}', '{"a":"x","c":1}']


def test_naming_convention_defaults():
    assert NamingConvention() == NamingConvention("kebab-case", True)
