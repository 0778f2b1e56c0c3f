"""Intermediate tables in the folder that all executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Whether shuffle files go when the statement that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings for Python stages over whole texts: batches of some MB, not of 10,000 texts of any length.
SMALL_BATCHES = {"spark_sql_execution_arrow_maxRecordsPerBatch": "1000"}
#: The lists of open `scratch` blocks.
_OPEN: list[list[str]] = []
#: Local folders by application, where the setting is absent: a running session doesn't take it.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the setting is absent and the master is local (tests), a temporary one is made."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
        found = _OWN[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's folder; `scratch` removes it too, whatever is written there."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    for paths in _OPEN:
        paths.append(path)
    return path


def materialise(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage, and every later reader sees the same rows.

    A lost executor costs nothing, as the files are in the shared folder. They stay until `scratch` or `clean_up` removes them; files
    of shuffles that led to the table go at once. Settings hold while it is written (`a_b` stands for `a.b`).
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    wanted = {_CLEANUP: "true"} | {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end the tables that were materialised inside it, but for those whose paths are taken from the list.

    What is needed later must have been written by then: nothing may still be computed from the removed tables.
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        # By identity: blocks inside one another have equal lists.
        _OPEN[:] = [p for p in _OPEN if p is not paths]
    for path in paths:
        _remove(spark, path)


def clean_up(spark: SparkSession) -> None:
    """Removes all tables that this application has materialised: for the end of a program, when its results are written."""
    _remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise_joined(df: DataFrame, name: str) -> DataFrame:
    """The same for a result of joins: Spark may have split its hot partitions into thousands, which needn't be files."""
    return materialise(df.coalesce(partitions(df.sparkSession)), name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
