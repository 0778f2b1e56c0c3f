"""Contiguous byte-balanced shards from global prefix sums, with DataFrame operations only.

Documents are put in ascending id order by a range partitioning, the bytes of each range are summed, and
the running sum over those totals (one row per range) gives every range its global offset. A document's
shard is then plain arithmetic on its own global byte offset: the law is `bytes`, shards are contiguous in
id order, and each cut is at most half a document away from an equal share. A cut depends on sizes and
order alone, so equal texts need not share a shard and a hot group can't fill one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import fresh
from .store import materialise, partitions

#: Range partitions per shuffle partition, so that hashing ranges to tasks stays even.
RANGES = 4


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, first_byte.

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty. Null ids sort first; rows that tie in
    id are ordered by checksum and size, repeated rows by where they were read, so that many of them don't fall into one
    range. Texts of any length count whole. Other columns are ignored. An
    empty table gives no rows. The text is read once; everything later works on three numbers per document.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "shard-sizes",
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    ranged = materialise(
        sized.repartitionByRange(RANGES * partitions(docs.sparkSession), *order).withColumn(
            "range", F.spark_partition_id()
        ),
        "shard-ranges",
    )
    # One row per range: a few thousand at any size of input, so the unpartitioned window and the broadcast are bounded.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
        .select(
            "range",
            F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("byte_base"),
            F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("row_base"),
            F.sum("range_bytes").over(everything).alias("all_bytes"),
        )
    )
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(within), "nth": F.count("*").over(within)})
        .join(F.broadcast(offsets), "range")
        .withColumn("first_byte", F.expr("byte_base + upto - size"))
        .withColumn("row", F.expr("row_base + nth - 1"))
        .withColumn("shard", F.expr(f"int((2 * first_byte + size) * {shards} div (2 * all_bytes))"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", F.expr("row - shard_row").alias("slot"), "first_byte"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole documents, all columns, under shard=N/ folders, sorted by slot.

    Every row is written once, whatever its id: null ids, ids that come several times and repeated rows too. Of rows with one id and text it
    doesn't matter which gets which of their slots. Columns named shard and slot are replaced. An empty table gives a table without rows.
    """
    plan = shard_by_bytes(docs, shards, id_col, text_col)
    names = fresh(docs, "_id", "_crc", "_size", "_nth", "shard_", "slot_")
    i, crc, size, nth, shard, slot = names
    # Rows of one id, checksum and size are told apart by a number. Many of them may be one group, so numbers are per partition, then per group.
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({i: F.col(id_col), crc: F.crc32(text.cast("binary")), size: F.octet_length(text).cast("long") + 1})
    left = _numbered(materialise(keyed, "shard-rows"), [i, crc, size], nth)
    right = _numbered(materialise(plan.select(F.col("doc_id").alias(i), F.col("text_crc32").alias(crc), F.col("size").alias(size), F.col("shard").alias(shard), F.col("slot").alias(slot)), "shard-plan"), [i, crc, size], nth)
    right = right.select(*(F.col(c).alias(f"r{c}") if c in (i, crc, size, nth) else F.col(c) for c in (i, crc, size, nth, shard, slot)))
    same = F.col(i).eqNullSafe(F.col(f"r{i}"))
    for c in (crc, size, nth):
        same = same & (F.col(c) == F.col(f"r{c}"))
    keep = [F.col(c) for c in docs.columns if c not in ("shard", "slot")]
    (
        left.join(right, same).select(*keep, F.col(shard).alias("shard"), F.col(slot).alias("slot"))
        .repartitionByRange(RANGES * shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    )


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a gapless number, from 0, among those of equal keys: by partition, and counts of earlier partitions."""
    part, row, base = fresh(rows, "_part", "_row", "_base")
    rows = rows.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()})
    own = F.row_number().over(Window.partitionBy(part, *keys).orderBy(row)) - 1
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(part, *keys).agg(F.count("*").alias("n")).withColumn(base, F.sum("n").over(before)).where(F.col(base).isNotNull())
    other = bases.select(base, *(F.col(c).alias(f"b{c}") for c in (part, *keys)))
    same = F.col(part) == F.col(f"b{part}")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"b{c}"))
    found = rows.withColumn(name, own).join(other, same, "left")
    return found.withColumn(name, F.col(name) + F.coalesce(base, F.lit(0))).select(*(rows[c] for c in rows.columns if c not in (part, row)), name)
