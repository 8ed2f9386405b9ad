import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ.setdefault("TZ", "UTC")

DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'").fetchall()
    for f in (DATA / "sf0.001").glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'").fetchall()
    return con


def plain(v):
    import decimal

    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(plain(r[c]) for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def against_sql(spark, duck):
    """Assert that a query and its SQL give the same rows on the smallest tables."""

    def check(query, text):
        df = query(spark, str(DATA / "sf0.001"))
        cols = sorted(df.columns)
        c = duck.execute(text)
        names = [x[0] for x in c.description]
        assert sorted(names) == cols
        order = [names.index(x) for x in cols]
        assert rows(df, *cols) == sorted((tuple(plain(r[i]) for i in order) for r in c.fetchall()), key=repr)

    return check
