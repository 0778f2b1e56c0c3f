import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def _views(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return int(value) if isinstance(value, float) and value == int(value) else value


@pytest.fixture(scope="session")
def same_rows(spark, small):
    """Whether a query's rows are those of its SQL."""
    import __spark_entry__ as entry

    con, queries, sql = _views(small), entry.queries(), entry.oracle_sql()

    def check(name):
        got = queries[name](spark, small)
        want = con.execute(sql[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        rows = lambda rs: sorted(repr(tuple(map(plain, r))) for r in rs)
        expected = rows(want.fetchall())
        assert rows(got.select(*names).collect()) == expected
        assert expected

    return check
