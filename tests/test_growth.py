"""What makes queries of the extraction slow on large tables: work done several times, or by one task."""

import pytest

from lodestrand.operators import detect as D


@pytest.mark.parametrize("name", ["active_visible", "stats"])
def test_the_strategies_are_evaluated_once(spark, small, name):
    import __spark_entry__ as entry

    times = lambda q: entry.queries()[q](spark, small)._jdf.queryExecution().optimizedPlan().toString().count("penugasan")
    assert times(name) == times("extract_blocks")


def test_a_token_is_looked_up_among_few(spark):
    tokens = sorted(D.weights(spark))
    maps = D._maps(tokens)
    assert sorted(t for m in maps for t in m) == tokens and all(tokens[i] == t for m in maps for t, i in m.items())
    assert max(map(len, maps)) <= 8


def test_block_files_are_those_of_many_tasks(spark, small):
    import __spark_entry__ as entry

    assert entry.queries()["block_files_roundtrip"](spark, small).rdd.getNumPartitions() >= 4
