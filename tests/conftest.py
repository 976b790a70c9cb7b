from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES


@pytest.fixture(scope="session")
def duck(tables):
    con = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    """Values as both engines agree on them."""
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="session")
def same(duck):
    """Whether a frame's rows and column names are those of a SQL text."""

    def check(df, sql):
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        expected = sorted(str(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names))) for r in cursor.fetchall())
        assert sorted(df.columns) == sorted(names)
        got = sorted(str(tuple(plain(v) for v in r)) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
        assert got == expected

    return check
