"""Exact copies by a stream with keyed state on disk.

The files of a folder are read as a stream. Its state has one entry per digest, in RocksDB under the checkpoint, and never
expires: the number of rows with that digest, and of the row that stays its id and its locator (file and row in it). Files that
land later are added by `update` alone; earlier ones aren't read again for that. `verdicts` then joins every row with
its entry and compares whole texts on hits: a row is a copy only if its bytes are those of the row that stays.

All of it is DataFrame operations. Digests of many rows are salted by their counts, which the state has, so no group of
copies is a hot key; the row that stays goes to each salt of its digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .keys import marked
from .store import fresh_path, materialise

#: A salted digest has at most about one in SHARES of all rows; so fewer than SHARES digests are salted.
SHARES = 2000
#: Bytes of input of one micro-batch.
BATCH_BYTES = 256 << 30
#: State on disk, with memory of fixed size however many of its partitions an executor holds.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each partition's manifest takes 4 MB of disk beforehand, however little state it has.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class CopyIndex:
    """The exact copies of a folder (or file) of Parquet files with columns id_col and text_col.

    A null text is an empty one; texts of any length count whole. Of equal texts the row with the largest id stays; null ids are
    the smallest, and of rows with the same id the last by file and place stays, so exactly one row of a group does. Other
    columns are ignored. The checkpoint names the state's folder; without one the state is a new one.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256):
        self.spark, self.path, self.checkpoint = spark, path, checkpoint or fresh_path(spark, "copies-state")
        self.schema = spark.read.parquet(path).schema
        self.id_col, self.text_col, self.digest = id_col, text_col, digest

    def _rows(self, files: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        place = F.struct(F.col(self.id_col).alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return files.select(place.alias("at"), self.digest(text).alias("digest"), text.alias("text"))

    def update(self, **options: object) -> None:
        """Read the files that the state doesn't know yet. A run that is broken off is taken up again from the checkpoint."""
        # A pattern that fits this path only: of a plain path the stream takes for granted that it is a folder.
        place = f"{self.path.rstrip('/')[:-1]}[{self.path.rstrip('/')[-1]}]"
        stream = self.spark.readStream.schema(self.schema).options(**(options or {"maxBytesPerTrigger": BATCH_BYTES})).parquet(place)
        kept = self._rows(stream).groupBy("digest").agg(F.max("at").alias("at"), F.count("*").alias("n"))
        with _settings(self.spark, _STATE):
            out = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.checkpoint)
            out.trigger(availableNow=True).start().awaitTermination()

    def state(self) -> DataFrame:
        """One row per digest: digest, stays (id, file and row), n."""
        with _settings(self.spark, _STATE):
            found = self.spark.read.format("statestore").load(self.checkpoint)
            return found.select("key.digest", F.col("value.max").alias("stays"), F.col("value.count").alias("n"))

    def verdicts(self) -> DataFrame:
        """One row per row of the files: doc_id, keep_id, group_size, kept, digest."""
        compared = materialise(self._compared(), "copies-compared")
        out = compared.where("same")
        if not compared.where("not same").isEmpty():
            # Different texts share a digest: those digests' rows are grouped by the texts themselves.
            clash = compared.where("not same").select("digest").distinct()
            rows = self._rows(self.spark.read.parquet(self.path)).join(clash, "digest", "left_semi")
            groups = rows.groupBy("digest", "text").agg(F.max("at").alias("stays"), F.count("*").alias("n"))
            again = rows.join(groups, ["digest", "text"]).select(*(c for c in compared.columns if c != "same"), F.lit(True).alias("same"))
            out = compared.join(clash, "digest", "left_anti").select(*compared.columns).unionByName(again)
        return out.select("at.doc_id", F.col("stays.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("stays")).alias("kept"), "digest")

    def _compared(self) -> DataFrame:
        """Of each row its digest's entry, and whether its text is that of the row that stays. One shuffle of the texts of hits."""
        state = materialise(self.state(), "copies-entries")
        total = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        state = state.withColumn("salts", F.expr(f"cast(least(n, n * {SHARES} div {max(total, 1)} + 1) as int)"))
        # Salted digests hold at least one in SHARES of all rows each, so this table is small at any size of input.
        salted = state.where("salts > 1").select("digest", "salts", "stays")
        rows, hit = marked(self._rows(self.spark.read.parquet(self.path)), F.col("digest"), state.where("n > 1").select("digest"))
        rows = rows.withColumn("text", F.when(F.col(hit), F.col("text"))).join(F.broadcast(salted), "digest", "left")
        own = F.pmod(F.xxhash64("at.file", "at.row"), F.coalesce("salts", F.lit(1)))
        # Each row once, with its own salt; a salted row that stays once more for each salt, to be compared with.
        copy = lambda salt, flag: F.struct(salt.cast("int").alias("salt"), F.lit(flag).alias("only_to_compare"))
        itself = F.array(copy(own, False))
        sent = F.when(F.col("at") == F.col("stays"), F.concat(itself, F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: copy(s, True))))
        rows = rows.select("at", "digest", "text", F.inline(F.coalesce(sent, itself)))
        entries = state.select("digest", "stays", "n", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        stays = F.when(F.col("at") == F.col("stays"), F.col("text"))
        together = rows.join(entries, ["digest", "salt"]).withColumn("first", F.max(stays).over(Window.partitionBy("digest", "salt")))
        same = (F.col("n") == 1) | F.coalesce(F.col("text") == F.col("first"), F.lit(False))
        return together.where("not only_to_compare").select("at", "digest", "stays", "n", same.alias("same"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The verdicts of any table; its ids and texts are written to files first, as locators need them."""
    path = fresh_path(docs.sparkSession, "copies-input")
    docs.select(id_col, text_col).write.parquet(path)
    index = CopyIndex(docs.sparkSession, path, id_col=id_col, text_col=text_col, digest=digest)
    index.update()
    return index.verdicts()
