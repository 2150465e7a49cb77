import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(rows):
    """Rows as sorted tuples of strings; null and NaN alike, whole floats as integers."""

    def show(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)

    return sorted(tuple(map(show, r)) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck, sf):
    """Compare a query with its SQL over the test tables."""

    def check(query, sql):
        df = query(spark, sf)
        got = df.toPandas()
        want = duck.execute(sql).fetchdf()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert normal(got[cols].itertuples(index=False)) == normal(want[cols].itertuples(index=False))
        return got

    return check
