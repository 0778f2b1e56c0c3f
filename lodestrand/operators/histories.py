"""State that follows from all earlier events of a group: splash screens shown, and selections after toggles.

A group may hold any share of the rows. So events are put in order by a range partitioning, running sums are taken in each range,
and what earlier ranges of the same group add is a few rows per range; no task and no array gets a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise, partitions

#: Range partitions per shuffle partition.
RANGES = 2


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in range partitions by the keys, with `part` and `seq` (the order in a part), written to a table."""
    ranged = rows.repartitionByRange(RANGES * partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return materialise(ranged.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "in-order")


def _joined(rows: DataFrame, runs: DataFrame, groups: list[str]) -> DataFrame:
    """rows with what their run's row says; runs without a row give nulls."""
    renamed = runs.select(*(F.col(c).alias(f"_{c}") for c in ("part", *groups)), *(c for c in runs.columns if c not in ("part", *groups)))
    same = F.col("part") == F.col("_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return rows.join(renamed, same, "left").drop("_part", *(f"_{g}" for g in groups))


def _of_runs(rows: DataFrame, groups: list[str], value: Column, carry) -> DataFrame:
    """(part, groups, carried): of groups in several ranges, what carry makes of earlier runs' values for each run."""
    window = Window.partitionBy(*groups)
    runs = rows.groupBy("part", *groups).agg(value.alias("_value")).withColumn("_runs", F.count("*").over(window))
    return runs.withColumn("carried", carry(F.col("_value"), window)).where("_runs > 1").drop("_value", "_runs")


def running(rows: DataFrame, groups: list[str], value: Column, name: str) -> DataFrame:
    """rows, which are `in_order`, with the sum of value over their group up to and with each row; written to a table."""
    rows = rows.withColumn("_one", value.cast("long"))
    before = lambda v, w: F.sum(v).over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = _of_runs(rows, groups, F.sum("_one"), before)
    own = F.sum("_one").over(Window.partitionBy("part", *groups).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    found = _joined(rows.withColumn("_own", own), earlier, groups)
    return materialise(found.withColumn(name, F.col("_own") + F.coalesce("carried", F.lit(0))).drop("_own", "_one", "carried"), "running")


# --- selections -------------------------------------------------------------------------------------------------------


def selection_history(actions: DataFrame, *order: str) -> DataFrame:
    """Of each action the number of selected blocks after it, and whether all visible ones are: (columns of actions), n_selected, every.

    Actions have a panel, an index to toggle (null: toggle all visible ones), whether that index is visible, and the panel's n_visible,
    which doesn't change. They are those of a panel in the given order, which must tell any two apart; nothing is selected before.

    After a toggle-all the visible blocks are alike, so what it does depends on how many of them had an odd number of toggles since
    the last one: with none it turns them, with all it leaves them, else it selects all. Only the turns since the last
    such selection count, so no action waits for the one before it.
    """
    all_, toggled = F.col("index").isNull(), F.col("index").isNotNull()
    seen = F.coalesce(F.col("visible"), F.lit(False)) & toggled
    rows = in_order(actions, "panel", *order)
    rows = running(rows, ["panel"], F.when(all_, 1).otherwise(0), "_alls")
    # A toggle-all belongs to the segment that it ends.
    rows = rows.withColumn("_segment", F.col("_alls") - F.when(all_, 1).otherwise(0))
    rows = running(rows, ["panel", "_segment", "index"], F.lit(1), "_times")
    odd = F.when(F.col("_times") % 2 == 1, 1).otherwise(-1)
    rows = running(rows, ["panel", "_segment"], F.when(seen, odd).otherwise(0), "_odd")
    rows = running(rows, ["panel", "index"], F.lit(1), "_ever")
    hidden = F.when(F.col("_ever") % 2 == 1, 1).otherwise(-1)
    rows = running(rows, ["panel"], F.when(toggled & ~seen, hidden).otherwise(0), "_hidden")
    some = F.col("n_visible") > 0
    turns = all_ & some & (F.col("_odd") == 0)
    selects = all_ & some & (F.col("_odd") != 0) & (F.col("_odd") != F.col("n_visible"))
    rows = running(rows, ["panel"], F.when(selects, 1).otherwise(0), "_since")
    rows = running(rows, ["panel", "_since"], F.when(turns, 1).otherwise(0), "_turns")
    on = ((F.col("_since") > 0).cast("int") + F.col("_turns")) % 2 == 1
    odd_now = F.when(all_, 0).otherwise(F.col("_odd"))
    visible = F.when(on, F.col("n_visible") - odd_now).otherwise(odd_now)
    return rows.select(*actions.columns, (visible + F.col("_hidden")).cast("long").alias("n_selected"), (some & (visible == F.col("n_visible"))).alias("every"))


# --- splash screens ---------------------------------------------------------------------------------------------------


def splash_shows(visits: DataFrame, ttl: int = 3_600_000) -> DataFrame:
    """(columns of visits), shown: whether a splash screen is shown at each visit (user, id, millis).

    One is shown if more than ttl milliseconds have passed since the user's last one. Only shows are remembered, so each depends
    on the one before it. A visit that long after the one before it is shown in any case. From every visit a pointer goes to
    the first that would be shown next; visits reached from sure ones are found by doubling the pointers, so the number
    of rounds is the logarithm of the longest chain. Visits at one time are in the order of their ids, which are unique.
    """
    rows = in_order(visits.select("user", "id", "millis"), "user", "millis", "id")
    # The visit before, of the same range or the last of an earlier one.
    lag = F.lag("millis").over(Window.partitionBy("part", "user").orderBy("seq"))
    last = _of_runs(rows, ["user"], F.max("millis"), lambda v, w: F.lag(v).over(w.orderBy("part")))
    gap = F.col("millis") - F.coalesce("_lag", "carried")
    rows = _joined(rows.withColumn("_lag", lag), last, ["user"]).select("user", "id", "millis", (gap.isNull() | (gap > ttl)).alias("sure"))
    rows = materialise(rows, "visits")
    # Each visit asks, at its time and ttl, for the next visit: that one comes behind it in the order of both.
    asked = rows.select("user", F.col("id").alias("asks"), (F.col("millis") + ttl).alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("bigint").alias("found"), F.lit(False).alias("sure"))
    there = rows.select("user", F.lit(None).cast(rows.schema["id"].dataType).alias("asks"), F.col("millis").alias("at"), F.lit(-1).alias("turn"), F.col("id").alias("found"), "sure")
    both = in_order(there.unionByName(asked).withColumn("tie", F.coalesce("found", "asks")), "user", "at", "turn", "tie")
    entry = F.when(F.col("turn") == -1, F.struct("found", "sure"))
    nearest = F.last(entry, ignorenulls=True).over(Window.partitionBy("part", "user").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    first = F.min_by(entry, F.when(F.col("turn") == -1, F.col("seq")))
    later = _of_runs(both, ["user"], first, lambda v, w: F.last(v, ignorenulls=True).over(w.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)))
    found = _joined(both.withColumn("_near", nearest), later, ["user"]).withColumn("next", F.coalesce("_near", "carried"))
    # What is shown in any case needs no pointer.
    pointers = materialise(found.where("turn = 0 and next is not null and not next.sure").select(F.col("asks").alias("from"), F.col("next.found").alias("to")), "pointers")
    shown = materialise(rows.where("sure").select("id"), "shown")
    while not pointers.isEmpty():
        reached = shown.join(pointers, shown["id"] == pointers["from"]).select(F.col("to").alias("id"))
        shown = materialise(shown.unionByName(reached).distinct(), "shown")
        further = pointers.select(F.col("from").alias("to"), F.col("to").alias("beyond"))
        pointers = materialise(pointers.join(further, "to").select("from", F.col("beyond").alias("to")), "pointers")
    marks = shown.select(F.col("id").alias("_id"), F.lit(True).alias("_shown"))
    return visits.join(marks, visits["id"] == marks["_id"], "left").select(*(visits[c] for c in visits.columns), F.coalesce("_shown", F.lit(False)).alias("shown"))
