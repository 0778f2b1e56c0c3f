"""Every query with SQL gives that SQL's rows."""

import pytest

from lodestrand.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, same_rows):
    same_rows(name)


def test_read_binary(spark, small):
    rows = QUERIES["read_binary"](spark, small).collect()
    assert [r.status for r in rows] == [500] and rows[0].error == "no reader for .parquet"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_no_python_in_plan(spark, small):
    plan = QUERIES["extract_blocks"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
