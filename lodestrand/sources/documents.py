"""Documents from files: (path, filename, size, text, error), by Spark's binary file reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_ext
from .office import office_rows

#: Types that are text as they are, and those that `office` reads. Others get an error, not a failed job.
TEXT_TYPES, OFFICE_TYPES = ("ipynb", "txt", "md", "html", "tex"), ("docx", "pptx", "xlsx")
#: Bytes of a file at most: Spark's reader fails the whole job on one of 2 GB, so larger ones are told by their lengths and not opened.
FILE_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: rows of a scan with fewer partitions (one file, one row group) are dealt out before heavy work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_files(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One row per file: path, filename, size, text, error. Text files are decoded as UTF-8, office files by `office`.

    A file of another type, one that isn't UTF-8, one that can't be unpacked and one of more than file_bytes has a null text and an error. Of a file without
    bytes Spark's reader gives no row. Only office files pass through Python.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/", -1), -1)
    large = files.where(F.col("length") > file_bytes).select("path", name.alias("filename"), F.col("length").alias("size"), F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error"))
    files = files.where(F.col("length") <= file_bytes).select("path", name.alias("filename"), F.col("length").alias("size"), file_ext(name).alias("kind"), "content")
    office = files.where(F.col("kind").isin(*OFFICE_TYPES))
    read = office.mapInArrow(office_rows, "path string, filename string, size bigint, text string, error string")
    plain = files.where(~F.col("kind").isin(*OFFICE_TYPES))
    is_text = F.col("kind").isin(*TEXT_TYPES)
    text = F.when(is_text, F.try_validate_utf8(F.col("content").cast("string")))
    error = F.when(~is_text, F.concat(F.lit("no reader for ."), F.col("kind"))).when(text.isNull(), "not UTF-8")
    return plain.select("path", "filename", "size", text.alias("text"), error.alias("error")).unionByName(read).unionByName(large)
