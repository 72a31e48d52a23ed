"""Sinks that tasks write: lines that count once, documents by offset."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from shelfmark.sinks import documents, lines, rows


def text_of(path):
    return "".join(open(f, encoding="utf-8").read() for f in lines.committed(str(path)))


def parts(path):
    return [n for n in os.listdir(path) if not n.startswith("_")]


def test_csv_files(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 'a,"b"').otherwise("ü").alias("t"), F.lit(None).cast("int").alias("none")).repartition(4)
    rows.write_csv(df, path, ("id",))
    expected = ["id,t,none", *[f'{i},"a,""b""",' if i % 3 == 0 else f"{i},ü," for i in range(1000)]]
    assert text_of(path) == "\n".join(expected) + "\n"
    rows.write_csv(df.where("id >= 990"), path, ("id",), mode="append")  # no second header
    assert text_of(path).splitlines() == expected + expected[-10:]
    rows.write_csv(df.where("id < 5"), path, ("id",))
    assert text_of(path).splitlines() == expected[:6] and len(parts(path)) == len(lines.committed(path))
    rows.write_csv(df.where("false"), path)
    assert text_of(path) == "" and lines.read_lines(spark, path).count() == 0
    rows.write_table(df.where("id < 2"), "t", str(tmp_path / "table"), ("id",))
    assert text_of(tmp_path / "table") == '- a,"b"\n- ü\n'


KILLED = '''
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from shelfmark.sinks import lines
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

@F.udf("string")
def line(i):
    if i == 70 and TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")  # after lines before it may have been written
    return f"line {i}"

df = spark.range(0, 100, 1, 4).select(line("id").alias("line"))
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
lines.write_lines(df, sys.argv[1], "head")
'''


def test_lost_attempt(tmp_path):
    """A task that fails after it has begun to write is repeated; its first file doesn't count."""
    path = str(tmp_path / "out")
    subprocess.run([sys.executable, "-c", KILLED, path], check=True, cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True)
    assert text_of(path).splitlines() == ["head", *[f"line {i}" for i in range(100)]]


def test_abort(spark, tmp_path):
    path = str(tmp_path / "out")
    lines.write_lines(spark.range(10).selectExpr("concat('x', id) AS line"), path)
    before = text_of(path)
    bad = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise("y").alias("line"))
    with pytest.raises(Exception, match="no"):
        lines.write_lines(bad, path)
    assert text_of(path) == before


def test_stream_and_replay(spark, tmp_path):
    schema, path = "id bigint", str(tmp_path / "out")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("concat('line ', id) AS line")
        lines.stream_lines(stream, path, str(tmp_path / checkpoint), "head").trigger(availableNow=True).start().awaitTermination()

    for k in range(2):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run("checkpoint")
    expected = ["head", *[f"line {i}" for i in range(20)]]
    assert text_of(path).splitlines() == expected
    writer = lines.StreamWriter({"path": path, "header": "head"})  # batch 1 once more, as after a crash before its offset was noted
    (tmp_path / "out" / "again.txt").write_text("line 10\n")
    writer.commit([lines.Written(0, "again.txt", 1)], 1)
    assert text_of(path).splitlines() == expected and "again.txt" not in os.listdir(path)


def test_documents(spark, tmp_path):
    texts = ["", "ä" * 1000, "x\ny", "🙂", None, "long " * 300_000] + [f"block {i} é" for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "n bigint, block string").repartition(5)
    expected = "head ü\n" + " – ".join(t or "" for t in texts) + "tail"
    document = documents.Document(df, ("n",), "head ü\n", " – ", "tail")
    assert documents.save(document, str(tmp_path / "a/doc.txt")) == len(expected.encode())
    assert (tmp_path / "a/doc.txt").read_text() == expected and os.listdir(tmp_path / "a") == ["doc.txt"]
    assert documents.save(documents.Document(df.where("false"), ("n",), "h", ",", "t"), str(tmp_path / "empty")) == 2
    assert documents.save(documents.Document(df.where("false"), ("n",)), str(tmp_path / "nothing")) == 0
    data = spark.range(50).select("id", F.lit('q"').alias("b"))
    documents.save(rows.json_array(data, ("id",)), str(tmp_path / "rows.json"))
    assert json.loads((tmp_path / "rows.json").read_text()) == [{"id": i, "b": 'q"'} for i in range(50)]
    with pytest.raises(ValueError, match="mounted"):
        documents.save(document, "hdfs://host/doc.txt")
