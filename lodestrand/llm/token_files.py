"""Token files: frequency-ranked ids in byte-aligned variable-length code, with separate control bytes.

An id is replaced by its rank among the corpus's ids, most frequent first, so that the common ones take one byte.
A block holds the ids of consecutive documents as two streams: control bytes, each with the byte lengths of four
ranks (two bits each), and data bytes, the ranks' low bytes in order. A reader finds all lengths of a block by one
look-up of its control bytes in a table of 256 x 4 lengths, so decoding is a few numpy passes.

The files are rows of (part, block, first, doc_ids, counts, control, data) in Parquet, which every store that Spark
reaches can hold, and a small table of ids by rank. Parts are ascending id ranges, blocks ascend in a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import SMALL_BATCHES, materialise, partitions
from .texts import slices
from .tokens import TEXT_BYTES, encoder

#: Ids in a block at least, but for a part's last one. A document is never divided.
BLOCK_IDS = 1 << 18
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit ranks."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = lengths - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    # No byte above the longest rank's is looked at.
    width = 2 if lengths.max(initial=1) <= 2 else 4
    data = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block, by table look-up of the control bytes."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    starts = ends - lengths
    ranks = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(lengths > k)
        ranks[long] |= raw[starts[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_type: str) -> DataFrame:
    """Blocks of plain ids: (part, block, first, doc_ids, counts, ids), in the order of the input's partitions.

    The last row of each partition with rows isn't a block: its part is null, and its counts are how often the partition has each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, block, first = encoder(tokenizer, added=True), TaskContext.get().partitionId(), 0, 0
        keys, counts, ids, total = [], [], [], np.zeros(0, dtype=np.int64)

        def flush():
            nonlocal block, first, keys, counts, ids, total
            every = np.concatenate(ids)
            now = np.bincount(every, minlength=len(total))
            now[: len(total)] += total
            total = now
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, sum(map(len, keys))], pa.int32()), pa.concat_arrays(keys)),
                 pa.ListArray.from_arrays(pa.array([0, sum(map(len, counts))], pa.int32()), pa.array(np.concatenate(counts))),
                 pa.array([every.astype("<u4").tobytes()], pa.binary())],
                ["part", "block", "first", "doc_ids", "counts", "ids"],
            )
            block, first, keys, counts, ids = block + 1, first + len(every), [], [], []
            return out

        for batch in batches:
            key_type = batch.schema.field(0).type
            for piece in slices(batch.column(1), TEXT_BYTES):
                rows = batch.column(1).slice(piece.row, len(piece)).to_pylist()
                found, n = tok.encode([t or "" for t in rows])
                keys.append(batch.column(0).slice(piece.row, len(piece)))
                counts.append(n + 1)
                ids.append(np.insert(found, np.cumsum(n), end_id))
                if sum(map(len, ids)) >= BLOCK_IDS:
                    yield flush()
        if ids:
            yield flush()
        if len(total):
            nothing = [pa.array([None], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(key_type))]
            each = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))
            yield pa.RecordBatch.from_arrays([*nothing, each, pa.array([None], pa.binary())], ["part", "block", "first", "doc_ids", "counts", "ids"])

    return docs.mapInArrow(
        run, f"part int, block int, first bigint, doc_ids array<{id_type}>, counts array<bigint>, ids binary"
    )


def _frequencies(blocks: DataFrame) -> DataFrame:
    """(id, n), from the tasks' counts: at most a row per id of the vocabulary from each task. The ids aren't read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0):
                now = np.array(counts.values)
                if len(now) > len(total):
                    total, now = now.copy(), total
                total[: len(now)] += now
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counts = blocks.where("part IS NULL").select("counts")
    return counts.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending id order (null ids first), to files under path.

    A null text is an empty one: only the end id. Rows that tie in id are ordered by their texts' first 32 characters, then by a hash;
    repeated rows by where they were read, so that many rows of one id, or of none, don't fall into one range. A text of any length
    counts whole and is tokenized at once. Other columns are ignored. An empty table gives files without rows. Texts are
    tokenized once; only the vocabulary's counts reach the driver.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", "head", "body", "tie"]
    keyed = plain.withColumns({"head": F.substring("text", 1, 32), "body": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    sorted_docs = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = materialise(_tokenized(sorted_docs, tokenizer, end_id, id_type), "token-ids", **SMALL_BATCHES)
    counts = [(r.id, r.n) for r in _frequencies(blocks).collect()]  # at most the vocabulary
    order = np.array([i for i, _ in sorted(counts, key=lambda x: (-x[1], x[0]))], dtype=np.int64)
    rank_of = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode_ranks(rank_of[np.frombuffer(x.as_buffer(), dtype="<u4")]) for x in batch.column(5)]
            streams = [pa.array([c[k] for c in coded], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *streams], [*batch.schema.names[:5], "control", "data"])

    schema = f"part int, block int, first bigint, doc_ids array<{id_type}>, counts array<bigint>, control binary, data binary"
    blocks.where("part IS NOT NULL").mapInArrow(run, schema).write.parquet(f"{path}/blocks")
    ranked = spark.createDataFrame([(k, int(i)) for k, i in enumerate(order)], "rank int, id int")
    ranked.coalesce(1).write.parquet(f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit, as binary)."""
    table = spark.read.parquet(f"{path}/ids").orderBy("rank").collect()  # at most the vocabulary
    id_of = np.array([r.id for r in table], dtype="<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                part, _, first, keys, counts, control, data = (c[k] for c in batch.columns)
                n = np.array(counts.values)
                ids = id_of[decode_ranks(control.as_py(), data.as_py(), int(n.sum()))]
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part.as_py(), np.int32)), keys.values, pa.array(first.as_py() + ends - n), pa.array(n),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int32)), pa.py_buffer(ids)])],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )

    decoded = blocks.select("part", "block", "first", "doc_ids", "counts", "control", "data").mapInArrow(
        run, f"part int, doc_id {id_type}, start bigint, n_tokens bigint, ids binary"
    )
    # A row per part: as many as the writer's range partitions.
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return decoded.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids"
    )
