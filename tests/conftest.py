"""One local session for all tests, and comparison with DuckDB."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="quarry-tests-")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        got = query(spark, DATA)
        cols = sorted(got.columns)
        want = duck.sql(sql)
        assert cols == sorted(want.columns)
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        a = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
        b = sorted(want.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)
        assert a == b

    return check
