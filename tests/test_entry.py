import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from shelfmark.plans import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SIZES = ("/root/testdata/sf0.01",)
TABLES = ("part", "orders", "events", "pages", "nation")


@pytest.fixture(scope="module", params=SIZES)
def duck(request):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{request.param}/{t}.parquet'")
    return con, request.param


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    duck, sf = duck
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    expected = sorted(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def test_without_training_data_operators(tmp_path):
    """The rest imports when the llm folders and the pipeline are gone."""
    shutil.copytree(f"{ROOT}/shelfmark", tmp_path / "shelfmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    # and so do the other tests
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    args = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_functions.py", "tests/test_operators.py"]
    subprocess.run(args, cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
