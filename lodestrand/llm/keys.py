"""Names of rows: columns that clash with none, and ids that come several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

#: Bits of the fixed-size map of ids that come several times.
MAP_BITS = 24


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Those names, made longer until docs has no column of them."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for k in range(len(taken) + 1) if (n := name + "_" * k) not in taken) for name in names]


def marked(docs: DataFrame, value: Column, members: DataFrame) -> tuple[DataFrame, str]:
    """docs and a boolean column: whether the value may be among the one column of members; and that column's name.

    True for every member; for another value by mistake, always or never. A map of fixed size is broadcast, at most
    2**(MAP_BITS - 6) rows. A null value isn't a member.
    """
    shared, place, word, bits = fresh(docs, "_shared", "_place", "_word", "_bits")
    at = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - MAP_BITS)
    places = members.select(at(F.col(members.columns[0])).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias(bits))
    words = materialise(words, "members")
    looked_up = docs.withColumn(place, at(value)).join(F.broadcast(words), F.shiftright(F.col(place), 6) == F.col(word), "left")
    there = F.expr(f"shiftrightunsigned(coalesce(`{bits}`, 0L), cast(`{place}` & 63 as int)) & 1") == 1
    return looked_up.select(*(docs[c] for c in docs.columns), (value.isNotNull() & there).alias(shared)), shared


def with_shared(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs and a boolean column: whether a row's id is null or comes several times; and that column's name."""
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    rows, shared = marked(docs, F.col(id_col), twice)
    return rows.withColumn(shared, F.col(shared) | F.col(id_col).isNull()), shared
