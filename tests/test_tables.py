"""Intermediate tables: what scratch and clean_up remove."""

import os

from lodestrand.sources.tables import clean_up, fresh_path, materialise, scratch, shared_dir


def place(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scratch_removes_what_is_not_taken(spark):
    kept = materialise(spark.range(3), "before")
    with scratch(spark) as outer:
        inner_kept = None
        with scratch(spark) as paths:
            gone, result = materialise(spark.range(4), "a"), materialise(spark.range(5), "b")
            places = [place(gone), place(result)]
            files = fresh_path(spark, "files")
            spark.range(2).write.parquet(files)
            paths.remove(next(p for p in paths if "/b-" in p))
        assert [os.path.exists(p) for p in places] == [False, True] and not os.path.exists(files.removeprefix("file://"))
        inner_kept = result.count()
    assert inner_kept == 5 and not os.path.exists(places[1]) and kept.count() == 3 and len(outer) == 3
    clean_up(spark)
    assert not os.path.exists(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://"))


def test_scratch_keeps_on_failure(spark):
    try:
        with scratch(spark):
            df = materialise(spark.range(3), "failed")
            raise RuntimeError
    except RuntimeError:
        assert df.count() == 3
