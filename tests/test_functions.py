"""Golden vectors of names, paths and globs; one Spark job per table."""

import posixpath
import re
import types

import pytest
from pyspark.sql import functions as F

from shelfmark import tables
from shelfmark.config import CAMEL, KEBAB, PASCAL, SNAKE, NamingConvention
from shelfmark.functions import guards, naming, paths
from shelfmark.functions.globs import glob_regex

STEMS = {
    KEBAB: {
        "TestFileName": "test-file-name", "test file name": "test-file-name", "test_file_name": "test-file-name", "TEST-FILE-NAME": "test-file-name",
        "test123file": "test123file", "test@file#name": "testfilename", "XMLFile": "xmlfile", "aBcD": "a-bc-d", "a - b": "a---b",
        "Résumé Final": "rsum-final", "文档": "", "-foo": "-foo", "a-": "a-", " file ": "-file-", "v1.2": "v12", "Brand#17": "brand17",
        "4-NOT SPECIFIED": "4-not-specified", "a b": "a-b", "a　﻿b": "a-b", "": "",
    },
    SNAKE: {
        "TestFileName": "test_file_name", "test file name": "test_file_name", "test-file-name": "test_file_name", "TEST_FILE_NAME": "test_file_name",
        "test@file#name": "testfilename", "a - b": "a_b", "-foo": "_foo", "a-": "a_", "aBcD": "a_bc_d",
    },
    CAMEL: {
        "test-file-name": "testFileName", "test_file_name": "testFileName", "test file name": "testFileName", "TestFileName": "testfilename",
        "-foo": "Foo", "a-": "a", "a - b": "aB", "test@file#name": "test@file#name", "Résumé Final": "résuméFinal",
    },
    PASCAL: {
        "test-file-name": "TestFileName", "test_file_name": "TestFileName", "test file name": "TestFileName", "testFileName": "Testfilename",
        "-foo": "Foo", "a-": "A", "a - b": "AB",
    },
}


@pytest.mark.parametrize("kind", STEMS)
def test_styles(spark, kind):
    df = spark.createDataFrame([(k,) for k in STEMS[kind]], "s string")
    got = {r.s: r.o for r in df.select("s", naming.STYLES[kind](F.col("s")).alias("o")).collect()}
    assert got == STEMS[kind]


FILENAMES = [
    ("Test File.txt", KEBAB, "test-file.txt"), ("Test File.txt", SNAKE, "test_file.txt"), ("Test File.txt", CAMEL, "testFile.txt"),
    ("Test File.txt", PASCAL, "TestFile.txt"), ("Test File.TXT", KEBAB, "test-file.txt"), ("TestFile", CAMEL, "testfile"),
    ("test file.txt", PASCAL, "TestFile.txt"), ("文档.pdf", KEBAB, ".pdf"), ("archive.tar.gz", KEBAB, "archivetar.gz"), (".bashrc", KEBAB, "bashrc"),
    ("My File.TXT", "other", "my file.txt"), ("test-file.txt", KEBAB, "test-file.txt"),
]


def test_apply_convention(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in FILENAMES], "n string")
    cols = [naming.apply_convention(F.lit(n), NamingConvention(t)).alias(f"c{i}") for i, (n, t, _) in enumerate(FILENAMES)]
    assert list(df.limit(1).select(*cols).first()) == [e for _, _, e in FILENAMES]
    needs = [naming.needs_rename(F.lit(n), NamingConvention(t)).alias(f"c{i}") for i, (n, t, _) in enumerate(FILENAMES)]
    assert list(df.limit(1).select(*needs).first()) == [n != e for n, _, e in FILENAMES]
    kept = naming.apply_convention(F.lit("My File.TXT"), NamingConvention("other", False))
    assert df.limit(1).select(kept.alias("k")).first().k == "My File.txt"


def test_extension_and_stem(spark):
    cases = {"a.TXT": (".txt", "a"), ".bashrc": ("", ".bashrc"), "foo.": (".", "foo"), "a.b.c": (".c", "a.b"), ".a.b": (".b", ".a"), "noext": ("", "noext")}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    rows = df.select("n", paths.extension(F.col("n")).alias("e"), paths.stem(F.col("n")).alias("s")).collect()
    assert {r.n: (r.e, r.s) for r in rows} == cases


def test_normalize_and_join(spark):
    cases = ["/a/b", "/a//b", "/a/./b", "/a/../b", "/../a", "a/..", "../../a", "a/../../b", "/a/b/..", ".", "/", "/a/.hidden", "a/b/../../../c"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    for r in df.select("p", paths.normalize(F.col("p")).alias("n"), paths.dirname(F.col("p")).alias("d")).collect():
        assert r.n == posixpath.normpath(r.p), r
    one = df.limit(1).select(
        paths.join("/base", F.lit("x/../y")).alias("a"), paths.join(F.lit(""), F.lit("y")).alias("b"), paths.normalize(F.lit("a/b/")).alias("c"),
        paths.normalize(F.lit("")).alias("d"), paths.dirname(F.lit("name")).alias("e"), paths.dirname(F.lit("/name")).alias("f"),
    ).first()
    assert tuple(one) == ("/base/y", "y", "a/b/", ".", ".", "/")


GLOBS = [
    ("report-*", "report-1.pdf", True), ("report-*", "sub/report-1.pdf", False), ("*", ".x", False), ("*.txt", ".txt", False), ("*.txt", "a.txt", True),
    ("**/*.js", "a/b/c.js", True), ("**/*.js", "c.js", True), ("**/*.js", ".a/c.js", False), ("a/**", "a/b/c", True), ("a/**", "a", False),
    ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab]c", "bc", True), ("[!ab]c", "bc", False), ("*.{js,ts}", "x.ts", True), ("*.{js,ts}", "x.py", False),
    ("a.b", "axb", False), ("x*", "x", True), ("*x", "x", True), ("*x", ".x", False),
    ("+(a|b).txt", "abba.txt", True), ("+(a|b).txt", ".txt", False), ("*(a|b)c", "c", True), ("?(a)b", "b", True), ("?(a)b", "aab", False), ("@(x|y*).js", "yes.js", True),
    ("!(a|b).txt", "c.txt", True), ("!(a|b).txt", "a.txt", False), ("!(a|b).txt", "ab.txt", True), ("!(a|b).txt", ".txt", False), ("d/!(x)/f", "d/y/f", True), ("d/!(x)/f", "d/x/f", False),
    ("f{1..3}.txt", "f2.txt", True), ("f{1..3}.txt", "f4.txt", False), ("f{01..10}", "f07", True), ("f{01..10}", "f7", False), ("{a..c}x", "bx", True), ("{a..e..2}x", "bx", False),
    ("!*.js", "a.ts", True), ("!*.js", "a.js", False), ("!!*.js", "a.js", True), ("{a}", "{a}", True), ("a/**", "a/b/", True), ("a/**", "a/", False), ("x(1).txt", "x(1).txt", True),
]


def test_globs():
    for pattern, path, expected in GLOBS:
        assert bool(re.search(glob_regex(pattern), path)) is expected, (pattern, path)
    assert re.search(glob_regex("node_modules/**", dot=True), "node_modules/.bin/x")
    assert not re.search(glob_regex("node_modules/**", dot=True), "pkg/node_modules/x")
    assert re.search(glob_regex(".DS_Store", dot=True), ".DS_Store")
    assert re.search(glob_regex("dist/**", dot=True), "dist/en/853/") and not re.search(glob_regex("dist/**", dot=True), "dist/")
    assert re.search(glob_regex("{1..20000}"), "19999") and not re.search(glob_regex("{1..20000}"), "20001")
    with pytest.raises(ValueError):
        glob_regex("{1..200000..2}")


def test_guards(spark):
    values = ['{"a":1}', '"x"', "1", "1.5", "1e300", "true", "[1]", "null", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    tests = [guards.is_object, guards.is_string, guards.is_number, guards.is_boolean, guards.is_array, guards.is_null_or_undefined, guards.is_primitive]
    rows = df.select("i", *[t(F.col("v")).alias(t.__name__) for t in tests]).orderBy("i").collect()
    hits = {t.__name__: [r.i for r in rows if r[t.__name__]] for t in tests}
    assert hits == {
        "is_object": [0], "is_string": [1], "is_number": [2, 3, 4], "is_boolean": [5], "is_array": [6], "is_null_or_undefined": [7, 8],
        "is_primitive": [1, 2, 3, 4, 5, 7, 8],
    }


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder, self.applicationId = master, folder, "app"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = "file:" + folder.removeprefix("file://") + "/own"


def session(master, folder=None, setting=None):
    return types.SimpleNamespace(sparkContext=Context(master, folder), conf=types.SimpleNamespace(get=lambda key, default: setting))


def test_shared_folder():
    assert tables.scratch(session("spark://a", "file:/b/c", "hdfs://d/e/"), "t").startswith("hdfs://d/e/shelfmark/app/t-")
    assert tables.scratch(session("spark://a", "file:/b/c"), "t").startswith("file:///b/c/shelfmark/app/t-")
    alone = session("local[2]")
    first, second = tables.scratch(alone, "t"), tables.scratch(alone, "t")
    assert first != second and first.rpartition("/")[0] == second.rpartition("/")[0] and first.startswith("file:///")
    with pytest.raises(ValueError):
        tables.scratch(session("spark://a"), "t")
