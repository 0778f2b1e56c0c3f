"""Repair of the structure of conversations: the cheapest edits after which roles read `(s?(ua)+)?`.

Turns are put in order by a range partitioning, windows flag their faults, and a fold over an array of at most CHUNK turns
carries four (cost, audit, pieces) structs, the cheapest edits that end in each state of the pattern, through `least`. A
longer conversation has several chunks, whose folds start in each of the four states; such tables of 4 x 4 structs are then
composed, COMPOSED chunks at a time. So no conversation is collected into one array, however many turns it has.

States are those of the pattern: 0 nothing yet, 1 after `s`, 2 after `u`, 3 after `a`. Of equal costs the least audit goes on.
That is safe: of two audits of the same turns with the same cost, none begins with the other, as only inserted turns make one longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.normalize import once
from .store import materialise, partitions

#: Turns of one fold, and chunks that one step of composition takes together.
CHUNK, COMPOSED = 256, 32
#: Range partitions per shuffle partition.
RANGES = 2
#: What edits cost: reroling, deleting, inserting, leaving a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space of blank turns and behind the last character.
BLANKS = " \t\n\x0b\f\r"
STATES = range(4)
_BEST = "struct<cost:bigint,audit:string,pieces:array<string>>"
_FROM = f"struct<{','.join(f's{k}:{_BEST}' for k in STATES)}>"


def damage(turns: DataFrame) -> DataFrame:
    """Turns with damage by crc32 of `conv_id:turn`, modulo 20, and `present`: whether the row is still there. Nulls count as a space.

    0 takes the turn away, 1 empties its text, 2 removes full stops, exclamation and question marks, 3 gives it twice, 4 makes it a user's.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(or_space("text"), ".!?", "")).otherwise(or_space("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


# --- the fold -----------------------------------------------------------------------------------------------------


def _plus(best: Column, cost: Column | int, letters: str) -> Column:
    """best with an edit more; null, which stands for a state that can't be reached, stays null."""
    longer = F.struct((best["cost"] + cost).alias("cost"), F.concat(best["audit"], F.lit(letters)).alias("audit"), best["pieces"].alias("pieces"))
    return F.when(best.isNotNull(), longer)


def _inserted(f: Column) -> Column:
    """The cheapest edits in each state after turns may have been inserted: at most one user and one assistant."""
    after_user = F.least(f["s2"], *(_plus(f[s], INSERT, "I") for s in ("s0", "s1", "s3")))
    after_assistant = F.least(f["s3"], _plus(f["s2"], INSERT, "I"), *(_plus(f[s], 2 * INSERT, "II") for s in ("s0", "s1")))
    return F.struct(f["s0"].alias("s0"), f["s1"].alias("s1"), after_user.alias("s2"), after_assistant.alias("s3"))


def _edited(g: Column, turn: Column) -> Column:
    """One turn kept, reroled or deleted. Blank and duplicate turns must go."""
    stays, left = ~(turn["blank"] | turn["duplicate"]), F.when(turn["truncated"], TRUNCATED).otherwise(0).cast("long")
    keep = lambda initial, best: F.when(stays & (turn["initial"] == initial), _plus(best, left, "K"))
    rerole = lambda best: F.when(stays, _plus(best, left + REROLE, "R"))
    before_user = F.least(g["s0"], g["s1"], g["s3"])
    return F.struct(
        _plus(g["s0"], DELETE, "D").alias("s0"),
        F.least(_plus(g["s1"], DELETE, "D"), keep("s", g["s0"])).alias("s1"),
        F.least(_plus(g["s2"], DELETE, "D"), keep("u", before_user), rerole(before_user)).alias("s2"),
        F.least(_plus(g["s3"], DELETE, "D"), keep("a", g["s2"]), rerole(g["s2"])).alias("s3"),
    )


def _start(state: Column) -> Column:
    nothing = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<string>").alias("pieces"))
    return F.struct(*(F.when(state == k, nothing).cast(_BEST).alias(f"s{k}") for k in STATES)).cast(_FROM)


def _fold(turns: Column, starts: Column) -> Column:
    """Of each start state the cheapest edits of the turns by end state; a chunk's audit becomes its one piece."""
    step = lambda f, turn: once(_inserted(f), lambda g: _edited(g, turn).cast(_FROM))
    as_piece = lambda b: F.when(b.isNotNull(), F.struct(b["cost"].alias("cost"), b["audit"].alias("audit"), F.array(b["audit"]).alias("pieces")))
    ended = lambda f: F.struct(*(as_piece(f[f"s{k}"]).alias(f"s{k}") for k in STATES))
    return F.transform(starts, lambda s: F.aggregate(turns, _start(s), step, ended))


def _composed(tables: Column) -> Column:
    """The table of consecutive chunks, from theirs in order."""

    def then(f: Column, table: Column) -> Column:
        def into(end: str) -> Column:
            def through(s: int) -> Column:
                a, b = f[f"s{s}"], table[s][end]
                joined = F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["pieces"], b["pieces"]).alias("pieces"))
                return F.when(a.isNotNull() & b.isNotNull(), joined)

            return F.least(*map(through, STATES))

        return F.struct(*(into(f"s{k}").alias(f"s{k}") for k in STATES)).cast(_FROM)

    return F.transform(F.array(*map(F.lit, STATES)), lambda s: F.aggregate(tables, _start(s), then))


def _finished(f: Column) -> Column:
    """The cheapest edits of a whole conversation, with what is inserted at its end: no turns at all, or an assistant's last."""
    return once(_inserted(f), lambda g: F.least(g["s0"], g["s3"]))


def _replayed(turns: Column, piece: Column, emitted: Column, system: Column) -> Column:
    """A chunk's repaired turns (role, text), by the edits of its piece: emitted and system tell what came before it.

    A turn that is inserted or reroled is the user's or the assistant's in turn, counted from the first or from behind the system's.
    """
    role = lambda n: F.when(n % 2 == 0, "user").otherwise("assistant")
    line = lambda r, text: F.struct(r.alias("role"), text.alias("text"))
    begin = F.struct(F.array().cast("array<struct<role:string,text:string>>").alias("out"), emitted.cast("int").alias("n"), system.cast("int").alias("system"))

    def edit(done: Column, both: Column) -> Column:
        turn, edits = both["turns"], both["edits"]
        op, n = F.right(edits, F.lit(1)), F.length(edits) - 1
        at = done["n"] - done["system"]
        new = F.slice(F.array(line(role(at), F.lit("")), line(role(at + 1), F.lit(""))), F.lit(1), n)
        kept = F.when(op == "K", F.array(line(turn["role"], turn["text"]))).when(op == "R", F.array(line(role(at + n), turn["text"])))
        own = F.coalesce(kept, F.array().cast("array<struct<role:string,text:string>>"))
        first = F.when((op == "K") & turn["role"].startswith("s"), 1).otherwise(0)
        return F.struct(
            F.concat(done["out"], new, own).cast("array<struct<role:string,text:string>>").alias("out"), (done["n"] + n + F.size(own)).cast("int").alias("n"),
            (done["system"] + first).cast("int").alias("system"),
        )

    pairs = F.arrays_zip(turns.alias("turns"), F.regexp_extract_all(piece, F.lit("I*[DKR]"), F.lit(0)).alias("edits"))
    return F.aggregate(pairs, begin, edit)


# --- order, faults and chunks ---------------------------------------------------------------------------------------


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns in range partitions: conv_id, turn, role, text, part, seq (order in the part), and what folds need of the text."""
    tidy = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keys = ["conv_id", "turn", "role", "head", "body", "tie"]
    tidy = tidy.withColumns({"head": F.substring("text", 1, 32), "body": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    ranged = tidy.repartitionByRange(RANGES * partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    return ranged.select(
        "conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"), F.unhex(F.md5(F.concat_ws("\0", "role", "text").cast("binary"))).alias("same"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows without texts, with their chunk, whether the conversation has one chunk only (`whole`), and their first fault."""
    run = Window.partitionBy("part", "conv_id")
    light = rows.drop("text").withColumns({"k": F.row_number().over(run.orderBy("seq")), "run": F.count("*").over(run)})
    light = light.withColumn("first_here", F.row_number().over(Window.partitionBy("part", "conv_id", "same").orderBy("seq")) == 1)
    light = materialise(light, "turns")
    # A border between ranges cuts one conversation at most, so fewer than there are ranges are in several.
    several = light.groupBy("conv_id", "part").agg(F.lit(1)).groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1")
    several = F.broadcast(several.select(F.col("conv_id").alias("_conv")))
    known = F.col("conv_id").eqNullSafe(F.col("_conv"))
    light = light.join(several, known, "left_semi").withColumn("spans", F.lit(True)).unionByName(
        light.join(several, known, "left_anti").withColumn("spans", F.lit(False))
    )
    # Only the first of a part can be the first of all: of each text at most one row per part is compared.
    ahead = F.min("part").over(Window.partitionBy("conv_id", "same")) < F.col("part")
    again = light.where("not spans or not first_here").withColumn("duplicate", ~F.col("first_here"))
    firsts = light.where("spans and first_here").withColumn("duplicate", ahead)
    duplicate, blank = F.col("duplicate") & ~F.col("blank"), F.col("blank")
    return again.unionByName(firsts).select(
        "conv_id", "part", ((F.col("k") - 1) / CHUNK).cast("long").alias("chunk"), "k", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        duplicate.alias("duplicate"), (F.col("open") & ~blank & ~duplicate).alias("truncated"), (~F.col("spans") & (F.col("run") <= CHUNK)).alias("whole"),
    )


def _chunks(light: DataFrame) -> DataFrame:
    """One row per chunk: its fold and what its faults and borders are."""
    fields = ("k", "turn", "initial", "blank", "duplicate", "truncated")
    grouped = light.groupBy("conv_id", "part", "chunk", "whole").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in fields[3:])
    )
    pairs = F.zip_with("turns", F.slice("turns", F.lit(2), F.size("turns")), lambda a, b: F.when(b.isNotNull(), ~_legal(a["initial"], b["initial"])))
    turns = F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())
    ends = {f"{name}_{what}": F.element_at("turns", at)[what] for name, at in (("first", 1), ("last", -1)) for what in ("turn", "initial")}
    starts = F.when(F.col("whole"), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, STATES)))
    return grouped.withColumns(
        {"n_illegal": F.size(F.filter(pairs, lambda p: p)).cast("long"), "low": F.array_min(turns), "high": F.array_max(turns),
         "turns_here": F.size(F.array_distinct(turns)).cast("long"), "table": _fold(F.col("turns"), starts)} | ends
    ).drop("turns")


def _legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("su", "ua", "au")


def _whole(chunks: DataFrame) -> DataFrame:
    counts = {"blank": F.col("n_blank"), "duplicate": F.col("n_duplicate"), "truncated": F.col("n_truncated"), "illegal": F.col("n_illegal")}
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns_here"), F.lit(0))
    return chunks.where("whole").select("conv_id", gaps.alias("gaps"), *(c.alias(n) for n, c in counts.items()), _finished(F.col("table")[0]).alias("best"))


def _joined(chunks: DataFrame) -> DataFrame:
    """The same of conversations with several chunks."""
    order = Window.partitionBy("conv_id").orderBy("part", "chunk")
    before = lambda c: F.lag(c).over(order)
    placed = chunks.where("not whole").withColumns({
        "at": F.row_number().over(order) - 1, "border": (~_legal(before("last_initial"), F.col("first_initial"))).cast("long"),
        "shared": (before("last_turn") == F.col("first_turn")).cast("long"),
    })
    placed = materialise(placed, "turn-chunks")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = placed.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns_here") + some("shared"), F.lit(0)).alias("gaps"),
        *(F.sum(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated")), (F.sum("n_illegal") + some("border")).alias("illegal"),
    )
    tables, last = placed.select("conv_id", "at", "table"), placed.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
    while last > 0:
        ordered = F.array_sort(F.collect_list(F.struct("at", "table")))
        grouped = tables.groupBy("conv_id", F.floor(F.col("at") / COMPOSED).cast("int").alias("at")).agg(ordered.alias("t"))
        tables, last = grouped.select("conv_id", "at", _composed(F.transform("t", lambda x: x["table"])).alias("table")), last // COMPOSED
    best = tables.select(F.col("conv_id").alias("_conv"), _finished(F.col("table")[0]).alias("best"))
    return counts.join(best, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


# --- results --------------------------------------------------------------------------------------------------------


def _edits(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns in order, their chunks, and the edits of each conversation that has a turn."""
    rows = materialise(_ordered(turns), "turns-in-order")
    chunks = materialise(_chunks(_numbered(rows)), "chunks")
    return rows, chunks, materialise(_whole(chunks).unionByName(_joined(chunks)), "edits")


def _repaired(rows: DataFrame, chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per chunk with its repaired turns: conv_id, whole, part, chunk, lines; the last one's have what is inserted at the end."""
    pieces = edits.select(F.col("conv_id").alias("_conv"), F.posexplode("best.pieces").alias("at", "piece"), F.size("best.pieces").alias("many"), F.col("best.audit").alias("audit"))
    order = Window.partitionBy("conv_id").orderBy("part", "chunk")
    places = chunks.where("whole").select("conv_id", "part", "chunk", "whole", F.lit(0).alias("at")).unionByName(
        chunks.where("not whole").select("conv_id", "part", "chunk", "whole", (F.row_number().over(order) - 1).alias("at"))
    )
    told = places.join(pieces, places["conv_id"].eqNullSafe(F.col("_conv")) & (places["at"] == pieces["at"])).drop("_conv", pieces["at"])
    k = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("seq"))
    texts = rows.withColumn("chunk", ((k - 1) / CHUNK).cast("long")).groupBy(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("chunk").alias("_chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )
    both = told.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("chunk") == F.col("_chunk")))
    # How many turns each chunk gives, and whether the system's is among them: only a first turn can be.
    ops = F.regexp_extract_all("piece", F.lit("I*[DKR]"), F.lit(0))
    system = F.exists(F.arrays_zip("turns", ops.alias("ops")), lambda x: F.right(x["ops"], F.lit(1)).eqNullSafe(F.lit("K")) & x["turns"]["role"].startswith("s"))
    both = both.withColumns({"gives": F.length(F.replace(F.col("piece"), F.lit("D"), F.lit(""))), "system": system.cast("int")})
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    cut = both.where("whole").withColumns({"emitted": none, "before": none}).unionByName(
        both.where("not whole").withColumns({"emitted": F.coalesce(F.sum("gives").over(prior), none).cast("int"), "before": F.coalesce(F.sum("system").over(prior), none).cast("int")})
    )
    done = cut.withColumn("done", _replayed(F.col("turns"), F.col("piece"), F.col("emitted"), F.col("before")))
    tail = F.length(F.regexp_extract("audit", "I*$", 0))
    role = lambda n: F.when(n % 2 == 0, "user").otherwise("assistant")
    at = F.col("done.n") - F.col("done.system")
    ends = F.slice(F.array(*(F.struct(role(at + i).alias("role"), F.lit("").alias("text")) for i in range(2))), F.lit(1), F.when(F.col("at") == F.col("many") - 1, tail).otherwise(0))
    return done.select("conv_id", "whole", "part", "chunk", F.concat("done.out", ends).alias("lines"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, text) rows to one (conv_id, hash) each; only the running hash is kept."""
    last, running, some = None, None, False
    for batch in batches:
        for conv, text in zip(*(c.to_pylist() for c in batch.columns)):
            if running is None or conv != last:
                if running is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last], batch.schema.types[0]), pa.array([running.hexdigest()])], ["conv_id", "hash"])
                last, running, some = conv, hashlib.sha256(), False
            if text is not None:
                running.update((("\n" if some else "") + text).encode())
                some = True
        kind = batch.schema.types[0]
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([running.hexdigest()])], ["conv_id", "hash"])


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, part, place, role, text; (part, place) ascends in a conversation's order."""
    lines = _repaired(*_edits(turns))
    found = lines.select("conv_id", F.struct("part", "chunk").alias("part"), F.posexplode("lines").alias("place", "x"))
    return found.select("conv_id", "part", "place", "x.role", "x.text")


def repair(turns: DataFrame) -> DataFrame:
    """One row per conv_id of turns (conv_id, turn, role, text and, if wanted, present):
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows whose `present` is false only tell that there is such a conversation; one without other rows gets zeros, an empty audit
    and the hash of an empty string. A null conv_id is an id like others, null roles and texts count as a space, null
    turns come first and count for no gap. Rows of one turn are ordered by role, the text's first 32 characters, then by hash; repeated rows are
    duplicates. Texts of any length count whole. Equality of texts is that of 128-bit hashes. Other columns are ignored.
    """
    ids = turns.select("conv_id").distinct()
    there = turns.where("present") if "present" in turns.columns else turns
    rows, chunks, edits = _edits(there)
    lines = _repaired(rows, chunks, edits)
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    written = lines.select("conv_id", "whole", "part", "chunk", F.when(F.size("lines") > 0, text).alias("text"))
    short = written.where("whole").select(F.col("conv_id").alias("_conv"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    long = written.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").select("conv_id", "text")
    hashes = short.unionByName(long.mapInArrow(_hashes, f"conv_id {kind}, hash string").select(F.col("conv_id").alias("_conv"), "hash"))
    found = edits.join(hashes, edits["conv_id"].eqNullSafe(hashes["_conv"])).select(F.col("conv_id").alias("_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "hash")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.join(found, ids["conv_id"].eqNullSafe(found["_id"]), "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("hash", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
