"""Block files on disk: bytes, names that clash, failed writes, overwriting."""

import os

import pytest
from pyspark.sql import functions as F

from lodestrand.sources.block_files import read_files, write_files

ROWS = [(1, "blocks_r.r", "r", "x <- 1\n\n# é"), (2, "blocks_r.r", "r", "y <- 2"), (2, "blocks_x/y.txt", "x/y", ""), (None, "a.txt", None, "z\r\n")]
SCHEMA = "doc_id bigint, filename string, lang string, content string"


def files_under(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_bytes_on_disk(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write_files(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path)
    found = files_under(tmp_path)
    assert {(f.rsplit("/", 3)[1], open(f, "rb").read()) for f in found} == {("_null" if d is None else str(d), c.encode()) for d, _, _, c in ROWS}
    assert len(found) == 4 and all("/part-" in f for f in found)
    assert {tuple(r) for r in read_files(spark, path).collect()} == set(ROWS)
    write_files(spark.createDataFrame(ROWS[:1], SCHEMA), path)
    assert read_files(spark, path).count() == 5
    write_files(spark.createDataFrame(ROWS[:1], SCHEMA), path, mode="overwrite")
    assert [tuple(r) for r in read_files(spark, path).collect()] == ROWS[:1]


def test_many_folders_are_several_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write_files(spark.range(0, 90, 1, 30).select(F.col("id").alias("doc_id"), F.lit("a.r").alias("filename"), F.lit("r").alias("lang"), F.col("id").cast("string").alias("content")), path)
    df = read_files(spark, path)
    assert df.rdd.getNumPartitions() == 2 and sorted(int(r.content) for r in df.collect()) == list(range(90))


def test_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(
        F.col("id").alias("doc_id"), F.lit("a.r").alias("filename"), F.lit("r").alias("lang"),
        F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise("x").cast("string").alias("content"),
    )
    with pytest.raises(Exception, match="broken"):
        write_files(rows, f"file://{tmp_path}/out")
    assert files_under(tmp_path) == []


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    os.makedirs(tmp_path / "out")
    write_files(spark.createDataFrame([], SCHEMA), path)
    assert read_files(spark, path).collect() == []
