import io
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfmark import __main__ as cli
from shelfmark import config as c
from shelfmark.plans.organizer import Organizer
from shelfmark.sinks.console import Console
from shelfmark.sinks.logger import Logger
from shelfmark.sources import inventory, json_text
from shelfmark.streaming.listing import plan_stream


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    names = [
        "Photo One.JPG", "notes.txt", "empty.dat", "_under.py", ".hidden", ".git/config", "node_modules/a/b.js", "pkg/node_modules/c.js", "sub/My Doc.pdf",
        "sub/deep/er/Photo One.JPG", "dist/x.txt",
    ]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("x" * (0 if "empty" in n else 3))
    os.symlink(root / "nowhere", root / "dangling.txt")
    return root


def test_scan(spark, tree):
    got = inventory.scan(spark, str(tree), c.Config()).orderBy("scan_index").collect()
    assert [r.rel_path for r in got] == ["Photo One.JPG", "_under.py", "empty.dat", "notes.txt", "pkg/node_modules/c.js", "sub/My Doc.pdf", "sub/deep/er/Photo One.JPG"]
    assert {r.rel_path: r["size"] for r in got}["empty.dat"] == 0
    shown = inventory.scan(spark, str(tree), c.Config(include_hidden=True, exclude_patterns=()))
    assert {".hidden", ".git/config", "node_modules/a/b.js"} <= {r.rel_path for r in shown.collect()}


def test_organize(spark, tree):
    organizer = Organizer(spark, c.Config(), str(tree))
    files = organizer.scan()
    ops = organizer.plan(files)
    dry = Organizer(spark, c.Config(dry_run=True), str(tree)).execute(ops)
    assert dry.where("status = 'success'").count() == ops.count() and (tree / "notes.txt").exists()
    predicted = {r.scan_index: r.status for r in organizer.predict(ops).collect()}
    done = organizer.execute(ops)
    assert {r.scan_index: r.status for r in done.collect()} == predicted
    assert (tree / "images/photo-one.jpg").exists() and (tree / "sub/deep/er/Photo One.JPG").exists()  # a collision
    assert "Target file already exists" in done.where("status = 'failed'").first().error
    document = organizer.manifest(done)
    organizer.save_manifests(document, str(tree / "out"))
    data = json.loads((tree / "out/manifest.json").read_text())
    assert data["failed"] == 1 and len(data["entries"]) == data["totalOperations"]
    assert (tree / "out/manifest.md").read_text().startswith("# ")


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "A File.txt"), (2, ".x/y.txt")], "scan_index bigint, rel_path string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scan_index bigint, rel_path string").parquet(str(tmp_path / "in"))
    query = plan_stream(stream, c.Config(), "/b").writeStream.format("memory").queryName("planned").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("planned").select("scan_index", "new_path").collect()] == [(1, "/b/documents/a-file.txt")]


def test_config(tmp_path, monkeypatch):
    base = c.Config()
    merged = c.merge(base, {"categories": [], "namingConvention": {"type": "camelCase"}, "logLevel": "warn", "excludePatterns": None})
    assert merged.categories == () and merged.naming_convention == c.NamingConvention("camelCase", True)
    assert merged.log_level == "warn" and merged.exclude_patterns == base.exclude_patterns
    assert c.merge(base, None) == base
    for name in ("x.json", "x.yml"):
        c.save(base, str(tmp_path / name))
        assert c.load(str(tmp_path / name)) == base
    assert c.find(str(tmp_path)) is None
    (tmp_path / "shelfmark.config.json").write_text('{"dryRun": true}')
    assert c.load(folder=str(tmp_path)).dry_run
    (tmp_path / ".shelfmark.yml").write_text("")
    assert c.load(folder=str(tmp_path)) == base
    with pytest.raises(FileNotFoundError):
        c.load(str(tmp_path / "missing.json"))
    with pytest.raises(ValueError):
        c.validate_format("toml")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init", "-f", "yaml"]) == 1 and cli.main(["init", "-f", "toml"]) == 1
    assert cli.main(["scan", str(tmp_path / "none")]) == 1


def test_cli(spark, tree, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["scan", str(tree)]) == 0
    assert "Move + Rename: 4" in capsys.readouterr().out
    assert cli.main(["organize", str(tree), "--dry-run"]) == 0
    assert cli.main(["organize", str(tree)]) == 1  # one collision
    assert (tmp_path / ".shelfmark/manifest.md").exists() and (tmp_path / ".shelfmark/shelfmark.log").exists()


def test_console():
    def shown(f):
        out = io.StringIO()
        f(Console(out, colour=False))
        return out.getvalue()

    assert shown(lambda k: k.csv([])) == ""
    assert shown(lambda k: k.csv([{"a": 1, "b": "x"}])) == "a,b\n1,x\n"
    assert shown(lambda k: k.csv([{"a": "p,q", "b": 'say "hi", ok'}])) == 'a,b\n"p,q","say ""hi"", ok"\n'
    assert shown(lambda k: k.csv([{"a": None, "b": True}])) == "a,b\n,true\n"
    assert shown(lambda k: k.csv([{"a": 1}, {"a": 2, "b": 3}, "skip"])) == "a\n1\n2\n"
    assert shown(lambda k: k.csv([{"a": {"k": 1}}])) == 'a\n{"k":1}\n'
    assert shown(lambda k: k.csv(["x", "y"])) == "x\ny\n"
    assert shown(lambda k: k.formatted(["x", 1], "table")) == "- x\n- 1\n"
    assert shown(lambda k: k.formatted({"a": 1}, "json")) == '{\n  "a": 1\n}\n'
    assert shown(lambda k: k.key_value("n", 3)) == "n: 3\n"
    for name in ("success", "info", "warning", "error", "section", "write"):
        assert shown(lambda k, n=name: getattr(k, n)("m")) == "m\n"
    assert shown(lambda k: k.newline()) == "\n"


def test_logger(spark, tmp_path, capsys):
    log = Logger("warn", str(tmp_path / "a/b.log"), colour=False)
    log.info("no")
    log.warn("w", {"k": 1})
    log.error("e")
    entries = log.entries()
    entries.clear()
    assert [e.message for e in log.entries()] == ["w", "e"]
    lines = (tmp_path / "a/b.log").read_text().splitlines()
    assert lines[0].endswith('[WARN] w {"k":1}') and lines[1].endswith("[ERROR] e")
    assert log.table(spark).count() == 2
    log.clear()
    assert log.entries() == [] and Logger("odd").should_log("error") is False


def test_json_text(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"a": 1}')
    (tmp_path / "j/b.json").write_text("{bad")
    rows = json_text.read_json_files(spark, str(tmp_path / "j")).select(F.col("data").isNull().alias("n")).collect()
    assert sorted(r.n for r in rows) == [False, True]
    assert json_text.parse_json("{bad") is None and json_text.read_json_file(str(tmp_path / "none")) is None
    assert json_text.write_json_file(str(tmp_path / "x/y.json"), {"a": [1]}) and json_text.read_json_file(str(tmp_path / "x/y.json")) == {"a": [1]}
    assert json_text.write_json_file(str(tmp_path / "z.json"), object()) is False
