"""One local session for all tests; partitions stay apart, so that groups are cut at partition bounds."""

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "2g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TABLES = "/root/testdata/sf0.001"


def plain(value):
    """A value as both engines can show it."""
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def against_sql(spark, query, sql, folder=TABLES):
    """Asserts that a query and its SQL give the same columns and rows."""
    import glob

    import duckdb

    with duckdb.connect() as db:
        for path in glob.glob(f"{folder}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        df, result = query(spark, folder), db.sql(sql)
        names = sorted(df.columns)
        assert sorted(result.columns) == names
        at = [result.columns.index(n) for n in names]
        want = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want
