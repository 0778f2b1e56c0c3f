"""Best-fit packing of tokenized documents into fixed-length sequences, after dominance reduction.

How pieces share sequences depends on their lengths alone, so the packing problem is a table of counts by length: at
most as many rows as the capacity, at any size of corpus. The driver solves that table. First Martello and Toth's
reduction: take the longest length; if all sets of other lengths that fit beside it are dominated by one single
length (none fits; one fills the rest exactly; no two fit; or the longest that fits is no shorter than any pair), fix
as many such sequences as there are pieces, and start again on the smaller table. What can't be reduced is packed by
best fit, longest first. Both fix many equal sequences in one step, so the plan is a short list of
(pattern, number of sequences). Pieces are then numbered within their length by per-task counts and prefix sums, and
each finds its place in the plan by its length and number: no piece passes through the driver or one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .texts import slices
from .tokens import TEXT_BYTES, encoder

CAPACITY = 2048
#: A pattern is [(length, how many)], in the order in which pieces stand.
Plan = list[tuple[list[tuple[int, int]], int]]


def reduce_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, dict[int, int]]:
    """Sequences that some best packing has, and the counts that remain."""
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: Plan = []
    again = True
    while again:
        again = False
        for top in sorted(left, reverse=True):
            if top not in left:
                continue
            partner = _dominating(left, top, capacity)
            if partner is None:
                continue
            if partner == 0:
                times, pattern = left.pop(top), [(top, 1)]
            elif partner == top:
                times, pattern = left[top] // 2, [(top, 2)]
                left[top] -= 2 * times
            else:
                times, pattern = min(left[top], left[partner]), [(top, 1), (partner, 1)]
                left[top] -= times
                left[partner] -= times
            left = {n: c for n, c in left.items() if c}
            fixed.append((pattern, times))
            again = True
    return fixed, left


def _dominating(left: dict[int, int], top: int, capacity: int) -> int | None:
    """The single length that dominates every set beside one piece of length top: 0 for none needed, None if no length does."""
    room = capacity - top
    fits = sorted(n for n in left if n <= room and (n != top or left[top] > 1))
    if not fits:
        return 0
    spare = lambda n: left[n] - (n == top)
    best = fits[-1]
    if best == room:
        return best
    low = fits[0]
    second = low if spare(low) > 1 else fits[1] if len(fits) > 1 else capacity
    if low + second > room:
        return best
    third = next((n for n, need in ((low, 3), (second, 2 if second != low else 3)) if spare(n) >= need), None)
    if third is None:
        third = next((n for n in fits if n > second), capacity)
    if low + second + third <= room:
        return None  # three or more fit: sets of three aren't compared
    pair, i, j = 0, 0, len(fits) - 1
    while i <= j:
        total = fits[i] + fits[j]
        if total > room:
            j -= 1
            continue
        if i < j or spare(fits[i]) > 1:
            pair = max(pair, total)
        i += 1
    return best if best >= pair else None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit, longest first; equal open sequences are filled together."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: list[tuple[int, int]], n: int) -> None:
        if n:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((pattern, n))

    for length in sorted(counts, reverse=True):
        rest = counts[length]
        while rest > 0:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, pattern, n = capacity, [], rest
            else:
                room = rooms[k]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            each = room // length
            full = min(n, rest // each)
            put(room - each * length, [*pattern, (length, each)], full)
            rest -= full * each
            if full < n and rest:
                put(room - rest * length, [*pattern, (length, rest)], 1)
                rest, full = 0, full + 1
            if pattern:
                put(room, pattern, n - full)
    return [x for patterns in open_.values() for x in patterns]


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    fixed, left = reduce_lengths(counts, capacity)
    return fixed + best_fit(left, capacity)


def lay_out(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first number) and rows (first sequence, how many a sequence, offset) to find places by."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length, each in pattern:
            start = taken.get(length, 0)
            rows.append((length << 44 | start, sequence, each, offset))
            taken[length] = start + each * n
            offset += each * length
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1:]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): pieces, each numbered among its task's of equal length."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seen = encoder(tokenizer, added=True), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for text in slices(batch.column(1), TEXT_BYTES):
                found, n = tok.encode([t or "" for t in batch.column(1).slice(text.row, len(text)).to_pylist()])
                ids = np.insert(found, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = (np.cumsum(n) - n)[row] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
                nth = np.empty_like(place)
                nth[order] = place
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(text.row, len(text)).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    )


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: a piece of the end id alone. Only documents longer than the capacity are cut; a text of any
    length is tokenized whole. Repeated rows and null ids are documents of their own. Other columns are ignored. An empty table gives no rows.
    """
    cut = materialise(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pack-pieces")
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {int(r.length): int(r.n) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    keys, places = lay_out(make_plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(k).to_numpy() for k in (3, 5))
            key = length << 44 | number
            at = np.searchsorted(keys, key, side="right") - 1
            sequence, each, offset = places[at].T
            nth = key - keys[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + nth // each), pa.array(offset + nth % each * length)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    id_type = cut.schema["doc_id"].dataType.simpleString()
    return (
        cut.join(bases, ["part", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
        .mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    )
