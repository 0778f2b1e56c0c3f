"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: a number, a name (a run of capitalised words inside a sentence) or a
measuring unit after a number is a typed placeholder, whose wording is kept as the slot's value; other words are
lower-cased. Windows of canonical tokens are the templates that a re-parameterised question shares with its source.
Windows of documents are hash-joined with windows of benchmark items. A window whose slots' values are the item's own
counts as it is. Elsewhere, along one run of windows, a value of the item must always stand for one value of the document
(two may become equal): windows with a slot that breaks this are dismissed as chance. An item leaks where the other
windows cover enough of it.

Texts are also taken as plain words, all lower-cased, without placeholders. Windows of these need identical wording but
for case, whatever numbers and names they hold, so that copies of texts dense in placeholders, short ones and copies
in another case are found too. An item of fewer than ALONE words must be a whole line or sentence of the document.

A document's windows meet all items that hold them, however many those are, so every leak is judged by all of its windows. Where
many items have a text in common (boilerplate, families of items), `leaks` can give the first of those that rest on the same
common windows only, one row instead of one for each item; `families` tells which items have windows in common.

Before the join, a window must find its bit in a map of the benchmark's hashes. The map has a fixed size (MAP_BITS),
so it can go to every task whatever the benchmark's size; a full map only lets more rows into the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import fresh
from .store import materialise
from .texts import ALNUM, U64, Texts, byte_class, mix, slices, text_hash, windows

WINDOW = 8
#: Words that a window of canonical tokens must have beside placeholders.
LITERALS = 4
#: An item of fewer words is no evidence; one of fewer than ALONE only as a whole line or sentence.
SHORTEST, ALONE = 2, 5
#: A window that more items hold is one of a family of items. Only `families`, and `leaks` where it gives one row for those alike, look at that.
FAMILY = 16
#: An item leaks if windows cover so many of its words in all, or this share of them or of its canonical tokens.
RUN, SHARE = 13, 0.5
MAP_BITS = 24

#: Units that count as such after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg t oz lb lbs gram grams kilogram kilograms ounce ounces pound pounds ton tons ml cl l "
    "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hrs hour hours day days week "
    "weeks month months year years dollar dollars cent cents euro euros percent degree degrees watt watts volt volts "
    "jahr jahre stunde stunden meilen tage an ans heure heures jours hora horas metros kilometros"
).split()

DIGIT = byte_class((0x30, 0x39))
STOP = byte_class((0x2E, 0x2E), (0x21, 0x21), (0x3F, 0x3F), (0x3A, 0x3A), (0x0A, 0x0A))
_WORD, _NUMBER, _NAME, _UNIT = range(4)
_PLACEHOLDER = mix(np.arange(1, 5, dtype=U64) * U64(0xA0761D6478BD642F))
_UNIT_HASHES = np.sort(np.array([text_hash(u) for u in UNITS], dtype=U64))


def canonical(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each canonical token: its hash, its slot's value (0 for words), its text and the number of its first word."""
    data, low = texts.data, texts.lowered()
    starts, ends, owner = texts.runs(ALNUM)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), owner, owner
    words = low.hashes(low.prefix_hash(), starts, ends)
    running = lambda table: np.concatenate(([0], np.cumsum(table[data])))
    digits, stops = running(DIGIT), running(STOP)
    number = digits[ends] - digits[starts] == ends - starts
    head = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    upper = (head >= 0x41) & (head <= 0x5A) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = owner[1:] != owner[:-1]
    gap = np.zeros(len(starts), dtype=np.int64)
    gap[1:] = starts[1:] - ends[:-1]
    opens = fresh.copy()
    opens[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    kind = np.where(number, _NUMBER, np.where(upper & ~opens, _NAME, _WORD))
    after_number = np.zeros(len(starts), dtype=bool)
    after_number[1:] = (kind[:-1] == _NUMBER) & ~fresh[1:] & (gap[1:] <= 1)
    at = np.minimum(np.searchsorted(_UNIT_HASHES, words), len(_UNIT_HASHES) - 1)
    kind[after_number & (kind == _WORD) & (_UNIT_HASHES[at] == words)] = _UNIT
    # 3.5 and 1,000 are one number, John Smith is one name.
    before = data[np.maximum(starts - 1, 0)]
    joins = np.zeros(len(starts), dtype=bool)
    joins[1:] = (kind[1:] == kind[:-1]) & ~fresh[1:] & (gap[1:] == 1)
    joins &= (kind == _NUMBER) & ((before == 0x2E) | (before == 0x2C)) | (kind == _NAME) & (before == 0x20)
    first = np.flatnonzero(~joins)
    value = np.add.reduceat(words * U64(3), first).view(np.int64)
    kind, owner = kind[first], owner[first]
    return np.where(kind == _WORD, words[first], _PLACEHOLDER[kind]), np.where(kind == _WORD, 0, value), owner, first


def plain_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each word of lower-cased texts, and whether it begins a line or sentence; lower-casing keeps the words' number."""
    starts, ends, owner = texts.runs(ALNUM)
    opens = np.ones(len(starts) + 1, dtype=bool)
    stops = np.concatenate(([0], np.cumsum(STOP[texts.data])))
    opens[1:-1] = (owner[1:] != owner[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    return texts.hashes(texts.prefix_hash(), starts, ends), owner, opens


def template_windows(docs: DataFrame, lengths: tuple[tuple[int, int], ...], bits: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """(id, words, tokens, form, n, at, hash, slots, places): windows of each text, of the given forms and lengths.

    `words` and `tokens` are the text's numbers of words and of canonical tokens, n the window's length in those of its
    form (0: canonical tokens, 1: words), `at` where it begins and `places` the words that it covers, of each
    placeholder one. With bits, only windows that find theirs, those of fewer than ALONE words only as whole lines or sentences,
    and of equal ones of form 1 in a text only the first.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                rows = batch.column(1).slice(part.row, len(part))
                tokens, slots, owner, word_at = canonical(part)
                lowered = pc.utf8_lower(pc.fill_null(rows.cast(pa.large_string()), ""))
                words, word_owner, opens = plain_words(next(slices(lowered, 1 << 62)))
                n_tokens, n_words = np.bincount(owner, minlength=len(part)), np.bincount(word_owner, minlength=len(part))
                first_token, first_word = np.cumsum(n_tokens) - n_tokens, np.cumsum(n_words) - n_words
                literal = np.concatenate(([0], np.cumsum(slots == 0)))
                for form, n in lengths:
                    hashes, at = windows(words, word_owner, n) if form else windows(tokens, owner, n)
                    hashes = mix(hashes + U64(n + 256 * form))
                    keep = np.ones(len(at), dtype=bool) if form else literal[at + n] - literal[at] >= LITERALS
                    if bits is not None:
                        place = hashes >> U64(64 - MAP_BITS)
                        keep &= bits[place.astype(np.int64)]
                        if n < ALONE:
                            begin, end = (at, at + n) if form else (word_at[at], np.append(word_at, len(words))[at + n])
                            keep &= opens[begin] & opens[end]
                    at, hashes = at[keep], hashes[keep]
                    text = (word_owner if form else owner)[at]
                    if form and bits is not None and len(at):
                        order = np.lexsort((at, hashes, text))
                        fresh = np.ones(len(order), dtype=bool)
                        fresh[1:] = (text[order][1:] != text[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
                        chosen = np.sort(order[fresh])
                        at, hashes, text = at[chosen], hashes[chosen], text[chosen]
                    if len(at):
                        inside = at[:, None] + np.arange(n)
                        filled = np.zeros(0, np.int64) if form else slots[inside].reshape(-1)
                        places = (inside if form else word_at[inside]) - first_word[text][:, None]
                        ends = np.arange(len(at) + 1, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(part.row, len(part)).take(pa.array(text)), pa.array(n_words[text]), pa.array(n_tokens[text]),
                             pa.array(np.full(len(at), form, np.int32)), pa.array(np.full(len(at), n, np.int32)),
                             pa.array(at - (first_word if form else first_token)[text]), pa.array(hashes.view(np.int64)),
                             pa.ListArray.from_arrays(pa.array(ends * (0 if form else n)), pa.array(filled)),
                             pa.ListArray.from_arrays(pa.array(ends * n), pa.array(places.reshape(-1)))],
                            ["id", "words", "tokens", "form", "n", "at", "hash", "slots", "places"],
                        )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, words bigint, tokens bigint, form int, n int, at bigint, hash bigint, slots array<bigint>, places array<bigint>"
    )


def _bits(items: DataFrame) -> np.ndarray:
    """A boolean per value of the hash's top MAP_BITS bits; at most 2**(MAP_BITS - 6) rows reach the driver."""
    top = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    rows = items.groupBy(F.shiftright(top, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int))")).alias("bits")
    )
    map_ = np.zeros(1 << MAP_BITS - 6, dtype="<u8")
    for r in rows.toLocalIterator():
        map_[r.word] = np.int64(r.bits).view(np.uint64)
    return np.unpackbits(map_.view(np.uint8), bitorder="little").view(bool)


def _item_windows(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    lengths = tuple((0, n) for n in range(LITERALS, WINDOW + 1)) + tuple((1, n) for n in range(SHORTEST, WINDOW + 1))
    items = template_windows(benchmark.where(F.col(item_id).isNotNull()), lengths, None, item_id, item_text)
    # An item shorter than the window is one window of its own length.
    size = F.when(F.col("form") == 0, F.col("tokens")).otherwise(F.col("words"))
    items = items.where((F.col("n") == WINDOW) | ((F.col("n") == size) & (size < WINDOW)))
    return items.select(F.col("id").alias("item_id"), F.col("words").alias("item_words"), F.col("tokens").alias("item_tokens"), "form", "n",
                        F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"), "places").distinct()


def _with_families(items: DataFrame) -> DataFrame:
    """Item windows with `first`, the first item that holds the window where more than FAMILY do, else null."""
    holders = items.groupBy("form", "n", "hash").agg(F.count_distinct("item_id").alias("holders"), F.min("item_id").alias("first"))
    many = holders.where(F.col("holders") > FAMILY).drop("holders")
    return items.join(many, ["form", "n", "hash"], "left")


def families(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(family, item_id): items that share a window with more than FAMILY others, and the item that stands for them; an item may have several."""
    found = _with_families(_item_windows(benchmark, item_id, item_text)).where("first IS NOT NULL")
    return found.select(F.col("first").alias("family"), "item_id").distinct()


def _one_of_each_family(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks but for those of items that rest on the same windows of families as a smaller item of the document.

    A leak rests on them if fewer than LITERALS of its words stand in no family's window: a word beside the common text is chance, and
    doesn't count as covered. Each document with a leak has a row.
    """
    words = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    common = items.where("first IS NOT NULL").groupBy("item_id").agg(words("places").alias("common"))
    leaks = leaks.join(common, "item_id", "left")
    own = F.size(F.array_except("own", F.coalesce("common", F.array().cast("array<bigint>"))))
    alike = Window.partitionBy("doc_id", "shared").orderBy("item_id")
    rests = (own < LITERALS) & (F.size("shared") > 0)
    first = F.when(rests, F.min(F.when(rests, F.col("item_id"))).over(alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    leaks = leaks.withColumns({"_first": first, "covered": F.col("covered") - F.when(rests, own).otherwise(0)})
    return leaks.where("_first IS NULL OR _first = item_id").drop("_first")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, every: bool = True) -> DataFrame:
    """The rows of `leaks`, where doc_id is a document's name: its id and its text's hash."""
    items = materialise(_item_windows(benchmark, item_id, item_text), "leak-items")
    if not every:
        items = materialise(_with_families(items), "leak-families")
        every = items.where("first IS NOT NULL").isEmpty()
    used = tuple((r.form, r.n) for r in items.select("form", "n").distinct().collect()) or ((0, WINDOW),)  # at most 2 * WINDOW rows
    named = docs.select(_name(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    found = template_windows(named, used, _bits(items), "doc", "text").select(F.col("id").alias("doc_id"), "form", "n", "hash", "at", "slots")
    pairs = found.join(items, ["form", "n", "hash"])
    slot_pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["i"] != 0)
    # Words in one case have no slots to agree on, so it doesn't matter where in the document they stand.
    pairs = pairs.withColumn("shift", F.when(F.col("form") == 0, F.col("at") - F.col("item_at")))
    # A run is a stretch of overlapping or adjoining windows of one alignment; no more rows than the item has windows.
    along = Window.partitionBy("doc_id", "item_id", "shift").orderBy("item_at")
    pairs = pairs.withColumn("gap", (F.col("item_at") > F.lag(F.col("item_at") + F.col("n")).over(along)).cast("int"))
    pairs = pairs.withColumn("run", F.coalesce(F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    hit = F.struct("places", slot_pairs.alias("pairs"),
                   (F.col("item_slots") == F.col("slots")).alias("same"), *(() if every else (
                   F.when(F.col("first").isNull(), F.col("places")).alias("own"), F.when(F.col("first").isNotNull(), F.array("hash")).alias("shared"))))
    # Hits are pre-aggregated by run: a document's windows stay few rows, however often an item is copied.
    runs = pairs.groupBy("doc_id", "item_id", "item_words", "item_tokens", "form", "shift", "run").agg(F.collect_set(hit).alias("hits"))
    runs = runs.withColumn("values", F.array_distinct(F.flatten(F.transform("hits", lambda h: h["pairs"]))))
    several = lambda i: F.size(F.filter("values", lambda v: v["i"] == i)) > 1
    item_values = F.array_distinct(F.transform("values", lambda v: v["i"]))
    runs = runs.withColumn("broken", F.when(F.size(item_values) < F.size("values"), F.filter(item_values, several))
                           .otherwise(F.array().cast("array<bigint>")))
    sound = lambda h: h["same"] | ~F.arrays_overlap(F.transform(h["pairs"], lambda v: v["i"]), F.col("broken"))
    runs = runs.withColumn("hits", F.filter("hits", sound)).where(F.size("hits") > 0)
    joined = lambda f: F.array_distinct(F.flatten(F.transform("hits", lambda h: h[f])))
    known = lambda f: F.array_distinct(F.flatten(F.filter(F.transform("hits", lambda h: h[f]), lambda x: x.isNotNull())))
    rest = () if every else ("own", "shared")
    consistent = runs.select("doc_id", "item_id", "item_words", "item_tokens", "form", joined("places").alias("places"), joined("pairs").alias("values"),
                             *(known(c).alias(c) for c in rest))
    union = lambda lists: F.array_distinct(F.flatten(F.collect_list(lists)))
    count = lambda lists: F.size(union(lists)).cast("long")
    found = (
        consistent.groupBy("doc_id", "item_id", "item_words", "item_tokens")
        .agg(count("places").alias("covered"), count("values").alias("n_slots"), count(F.when(F.col("form") == 0, F.col("places"))).alias("templates"),
             *(F.sort_array(union(c)).alias(c) for c in rest))
        .where((F.col("covered") >= RUN) | (F.col("covered") >= SHARE * F.col("item_words")) | (F.col("templates") >= SHARE * F.col("item_tokens")))
    )
    found = found if every else _one_of_each_family(found, items)
    return found.select("doc_id", "item_id", F.col("item_words").alias("item_tokens"), "covered", "n_slots")


def _name(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", every: bool = False) -> DataFrame:
    """One row per document and benchmark item that leaks into it: doc_id, item_id, item_tokens, covered, n_slots.

    `item_tokens` counts the item's words, `covered` those in matching windows without contradicted slots (a
    placeholder is one word); n_slots its distinct slot values there. Rows that share an id, or have none, are documents of their own
    if their texts differ, and one document otherwise; repeated items count as one. Null and empty texts, items without an id and
    items of fewer than SHORTEST words match nothing. Texts of any length are read whole. Other columns are ignored. An empty
    table on either side gives no rows. With `every`, all items that leak have their rows; without, of items that rest on the same windows of
    families in a document (see FAMILY) the first. Either way each document with a leak has a row.
    """
    return _leaks(docs, benchmark, id_col, text_col, item_id, item_text, every).withColumn("doc_id", F.col("doc_id.id"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, into which no benchmark item leaks. Rows that share an id, or have none, stand or fall by their own texts."""
    (name,) = fresh(docs, "_name")
    dirty = _leaks(docs, benchmark, id_col, text_col, item_id, item_text).select(F.col("doc_id").alias("_dirty")).distinct()
    named = docs.withColumn(name, _name(id_col, text_col))
    return named.join(dirty, named[name].eqNullSafe(dirty["_dirty"]), "left_anti").drop(name)
