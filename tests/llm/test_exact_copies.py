"""Exact copies against a dictionary, with digests that clash, files that land later, and odd rows."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.llm.exact_copies import CopyIndex, classes


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    largest = {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    return Counter((i, largest[t or ""], len(groups[t or ""])) for i, t in rows), len(groups)


def check(got, rows):
    got = got.collect()
    counts, n_groups = expected(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == counts
    assert sum(r.kept for r in got) == n_groups and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_query(same_rows):
    same_rows("op12_stream_dedup")


def test_no_python(spark, small):
    from lodestrand.llm.queries import QUERIES

    plan = QUERIES["op12_stream_dedup"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("digest", [None, lambda c: F.crc32(c.cast("binary")) % 5, lambda c: F.lit(1)])
def test_odd_rows(odd, odd_rows, digest):
    got = classes(odd, **({"digest": digest} if digest else {}))
    check(got, odd_rows)
    if not digest:
        hashes = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_rows)
        assert Counter((r.doc_id, r.digest.hex()) for r in got.collect()) == hashes


def test_empty(empty):
    assert classes(empty).collect() == []


def test_a_third_of_all_rows(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"text {i}") for i in range(9000)]
    check(classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)), rows)


def test_files_land_later(spark, tmp_path):
    path, rows = f"file://{tmp_path}/landing", []
    for k in range(3):
        new = [(100 * k + i, f"text {i % (5 + k)}") for i in range(20)]
        rows += new
        spark.createDataFrame(new, "doc_id bigint, text string").coalesce(2).write.mode("append").parquet(path)
        index = CopyIndex(spark, path, checkpoint=f"file://{tmp_path}/state")
        index.update(maxFilesPerTrigger=1)
        check(index.verdicts(), rows)
        assert index.state().agg(F.sum("n")).first()[0] == len(rows)
    index.update()
    check(index.verdicts(), rows)


def test_small_state_takes_little_disk(spark, tmp_path):
    """Partitions of the state that hold next to nothing don't take megabytes each."""
    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    manifests = lambda: {os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f.startswith("MANIFEST")}
    before, path = manifests(), f"file://{tmp_path}/rows"
    spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id bigint, text string").write.parquet(path)
    CopyIndex(spark, path, checkpoint=f"file://{tmp_path}/state").update()
    new = manifests() - before
    assert new and all(os.stat(f).st_blocks * 512 < 1 << 20 for f in new)
