"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, banded, then verified exactly.

A document is a bag of five-word shingles; two documents are near duplicates if the weighted Jaccard similarity of
their bags, sum of minima over sum of maxima, is 0.8 or more. Each shingle owns a Poisson process over its weight axis,
cut into the dyadic cells [0, 1), [1, 2), [2, 4), ...; a point has an arrival time, a register and, by further random
bits, the unit of the cell it falls in: that is the hierarchical splitting, and a point counts for a document if its
unit lies below the shingle's weight there. A register keeps its earliest point, and two documents agree in a register
with a chance equal to their weighted Jaccard similarity. Points are made in order of arrival and only up to a time by
which all registers are filled, so most shingles cost one draw.

Candidates meet in bands of registers. Copies of one word sequence are one class from the start, and a bucket's members
are compared with its smallest member, not with each other. Pairs that this could miss - in one bucket, not
yet in one class - are then compared too, but for those that the triangle inequality of the Jaccard distance rules
out. So no link between different texts that share a bucket is lost, and large groups stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .keys import fresh, with_shared
from .store import materialise, materialise_joined
from .texts import ALNUM, U64, Texts, mix, slices, windows

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a band with a chance of 1 - (1 - 0.8**4)**20 = 0.99997.
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Expected points per register within the first time limit.
_REACH = 8.0
#: Nodes at most whose edges are joined by a broadcast.
HUBS = 2000
#: Bits of the fixed-size map of wanted documents that goes to every task.
_MAP_BITS = 24
#: Bits of a bag's own map, in 64-bit words; see _stranger_links.
_BAG_WORDS = 32
_STEP = U64(0x9E3779B97F4A7C15)


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of each distinct shingle, by text and shingle; and two content hashes per text.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A text of one to four
    words has one shingle, all of it.
    """
    low = texts.lowered()
    starts, ends, owner = low.runs(ALNUM)
    words = low.hashes(low.prefix_hash(), starts, ends)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    place = mix((np.arange(len(words)) - first[owner] + 1).astype(U64))
    content = np.zeros((len(texts), 2), dtype=U64)
    for k in (0, 1):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(words + place * (_STEP + U64(2 * k))))))
        content[:, k] = sums[first + counts] - sums[first]
    keys, at = windows(words, owner, SHINGLE)
    found, texts_of = [keys], [owner[at]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.zeros(len(short), dtype=U64)
            for k in range(n):
                total = total * U64(0xD1342543DE82EF95) + words[first[short] + k]
            found.append(mix(total + U64(n)))
            texts_of.append(short)
    keys, text = np.concatenate(found), np.concatenate(texts_of)
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], keys[begin], np.diff(np.append(begin, len(keys))), content


def signatures(text: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The BagMinHash registers of n bags, as the 64-bit names of each register's earliest point; 0 in empty bags."""
    out = np.zeros((n, REGISTERS), dtype=U64)
    total = np.bincount(text, weight, minlength=n)
    limit = np.full(n, _REACH) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        use = todo[text]
        t, key, w = text[use], keys[use], weight[use]
        cell = np.zeros(len(t), dtype=np.int64)
        parts = [(t, key, w, cell)]
        low = 1
        while (more := w > low).any():
            parts.append((t[more], key[more], w[more], np.full(int(more.sum()), low)))
            low *= 2
        t, key, w, cell = (np.concatenate(x) for x in zip(*parts))
        width = np.maximum(cell, 1)
        state = mix(key ^ mix(cell.astype(U64) + U64(1)))
        time = np.zeros(len(t))
        slots, times, names = [], [], []
        while len(t):
            state = state + _STEP
            bits = mix(state)
            time = time - np.log(((bits >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (REGISTERS * width)
            live = time <= limit[t]
            t, w, cell, width, state, time, bits = (x[live] for x in (t, w, cell, width, state, time, bits))
            more = mix(bits ^ _STEP)
            counts = cell + (more >> U64(32)).astype(np.int64) % width < w
            slots.append((t * REGISTERS + (more & U64(0xFFFFFFFF)).astype(np.int64) % REGISTERS)[counts])
            times.append(time[counts])
            names.append(bits[counts])
        slot, time, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        order = np.lexsort((time, slot))
        slot, name = slot[order], name[order]
        first = np.ones(len(slot), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[first]] = name[first]
        filled = np.bincount(slot[first] // REGISTERS, minlength=n) == REGISTERS
        todo &= ~filled
        limit *= 2
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    total = np.zeros((len(registers), BANDS), dtype=U64) + mix(np.arange(1, BANDS + 1, dtype=U64))
    for k in range(ROWS):
        total = total * U64(0xD1342543DE82EF95) + registers[:, k::ROWS]
    return mix(total)


def _sketches(docs: DataFrame) -> DataFrame:
    """(key, doc_id, c1, c2, bands) of each row of docs (key, doc_id, text): its content's hash and its bands' keys."""
    types = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("key", "doc_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                text, keys, weight, content = shingles(part)
                found = bands(signatures(text, keys, weight, len(part)))
                empty = np.bincount(text, minlength=len(part)) == 0
                ends = np.cumsum(np.where(empty, 0, BANDS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(part.row, len(part)) for k in (0, 1)), pa.array(content[:, 0].view(np.int64)),
                     pa.array(content[:, 1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(found[~empty].reshape(-1).view(np.int64)))],
                    ["key", "doc_id", "c1", "c2", "bands"],
                )

    return docs.mapInArrow(run, f"{', '.join(types)}, c1 bigint, c2 bigint, bands array<bigint>")


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, bag, bits) of wanted documents: names of shingle occurrences, sorted, and a map of their top bits.

    Others are sifted out before any work.

    A map of fixed size tells whose hash is wanted; the exact join follows, so a full map costs time only.
    """
    top = 64 - _MAP_BITS
    rows = wanted.select(F.xxhash64("doc_id").alias("h")).groupBy(F.shiftright(F.shiftrightunsigned("h", top), 6).alias("word"))
    sieve = np.zeros(1 << _MAP_BITS - 6, dtype="<u8")
    for r in rows.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {top}) & 63 as int))")).alias("b")).toLocalIterator():
        sieve[r.word] = np.int64(r.b).view(np.uint64)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy().view(np.uint64) >> U64(top)
            chosen = batch.filter(pa.array((sieve[(place >> U64(6)).astype(np.int64)] >> (place & U64(63)) & U64(1)).astype(bool)))
            for part in slices(chosen.column(1)):
                text, keys, weight, _ = shingles(part)
                nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                names = mix(np.repeat(keys, weight) + nth.astype(U64) * _STEP)
                owner = np.repeat(text, weight)
                names = names[np.lexsort((names, owner))].view(np.int64)
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(part)))).astype(np.int32)
                bits = np.zeros((len(part), _BAG_WORDS), dtype=U64)
                place = (names.view(U64) >> U64(32)).astype(np.int64) % (64 * _BAG_WORDS)
                np.bitwise_or.at(bits, (np.sort(owner), place // 64), U64(1) << (place % 64).astype(U64))
                rows = pa.array(np.arange(len(part) + 1, dtype=np.int32) * _BAG_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [chosen.column(0).slice(part.row, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(names)),
                     pa.ListArray.from_arrays(rows, pa.array(bits.reshape(-1).view(np.int64)))],
                    ["doc_id", "bag", "bits"],
                )

    sifted = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, f"doc_id {id_type}, bag array<bigint>, bits array<bigint>")
    # Repeated rows of an id are one bag: the smallest.
    exact = sifted.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return exact.groupBy("doc_id").agg(F.min(F.struct("bag", "bits")).alias("x")).select("doc_id", "x.bag", "x.bits")


def _similarities(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, similarity) of distinct pairs of document ids."""
    id_type = bags.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            out = np.zeros(len(batch))
            for k in range(len(batch)):
                a, b = x[k].values.to_numpy(), y[k].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                out[k] = both / (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "similarity"])

    left = bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("x"))
    right = bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, f"a {id_type}, b {id_type}, similarity double")


def _under_least(edges: DataFrame, least: Column, which: Column, also: Column | None = None) -> DataFrame:
    """(b, m) of the chosen edges (a, b), with m from a's least b; and, with `also`, (that, m) of each a.

    A node with more than a 1/HUBS of all edges is a hub. There are fewer than HUBS, so hubs and their least neighbours are
    broadcast, and their edges stay where they lie; the others are joined by shuffles that no node can make uneven.
    """
    ends = materialise_joined(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "star-least")
    ends = ends.select("a", least.alias("m"), "n")
    limit = ends.agg(F.sum("n")).first()[0] / HUBS
    hubs = F.broadcast(ends.where(F.col("n") > limit).select("a", F.col("m").alias("hub")))
    chosen = edges.where(which).join(hubs, "a", "left")
    far = chosen.where("hub IS NULL").select("a", "b").join(ends.where(F.col("n") <= limit).select("a", "m"), "a").select("b", "m")
    out = chosen.where("hub IS NOT NULL").select("b", "hub").union(far)
    if also is not None:
        out = out.union(ends.select(also, "m"))
    return out.toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in edges (a, b); the label is the component's smallest node.

    Large-star and small-star rounds: each hangs nodes under ever smaller neighbours, until every node hangs under its
    label. All of it is joins and aggregates of minima; each round is written to the shared folder.
    """
    def down(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = materialise_joined(down(edges), "star")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise_joined(down(_under_least(both, F.least("a", "m"), F.col("b") > F.col("a"))), "star")
        # Each node stays under its least neighbour, and the others go there, too.
        edges = materialise_joined(down(_under_least(large, F.col("m"), F.lit(True), F.col("a"))), "star")
        # Done when each node hangs under one node, which itself hangs under none.
        ups = edges.groupBy("a").agg(F.count("*").alias("n"))
        if ups.where("n > 1").isEmpty() and edges.join(ups.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _stranger_links(named: DataFrame, banded: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b): links between a stranger of a bucket and another member that isn't in its class.

    All is decided in the join's condition, cheap tests first, so that only links come out of it: the classes differ,
    the similarities to the leader allow a link, sizes allow one, the bucket is the first that both share, the bags'
    maps allow a link (each bit that only the first bag has is an occurrence that the second lacks), and the bags agree.
    No test but the last needs more than a few machine instructions a word. Sort-merge joins keep no bucket in memory,
    and Spark splits the hot ones.
    """
    mixed = named.join(named.where("stranger").select("key").distinct(), "key", "left_semi")
    full = mixed.join(banded, "rep").join(bags.withColumnRenamed("doc_id", "rep"), "rep")
    full = full.select(
        "key", "rep", "similarity", "mine", "stranger", F.array_position("bands", F.col("key")).alias("band"),
        *(F.get("bands", F.lit(k)).alias(f"k{k}") for k in range(BANDS - 1)), *(F.get("bits", F.lit(k)).alias(f"w{k}") for k in range(_BAG_WORDS)),
        "bag", F.size("bag").alias("size"),
    )
    a = full.where("stranger").select(*(F.col(c).alias(f"a_{c}") for c in full.columns))
    b = full.select(*(F.col(c).alias(f"b_{c}") for c in full.columns))
    size = [F.col("a_size"), F.col("b_size")]
    earlier, alone = F.lit(False), F.lit(0)
    for k in range(BANDS - 1):
        earlier = earlier | ((F.col("a_band") > k + 1) & (F.col(f"a_k{k}") == F.col(f"b_k{k}")))
    for k in range(_BAG_WORDS):
        alone = alone + F.bit_count(F.col(f"a_w{k}").bitwiseAND(F.bitwise_not(F.col(f"b_w{k}"))))
    enough = SIMILARITY * (size[0] + size[1]) - 1e-9
    tests = (
        (F.col("a_mine") != F.col("b_mine")) & (~F.col("b_stranger") | (F.col("b_rep") < F.col("a_rep"))),
        F.abs(F.col("a_similarity") - F.col("b_similarity")) <= 1 - SIMILARITY + 1e-9,
        F.least(*size) >= SIMILARITY * F.greatest(*size),
        ~earlier,
        (size[0] - alone) * (1 + SIMILARITY) >= enough,
        F.size(F.array_intersect("a_bag", "b_bag")) * (1 + SIMILARITY) >= enough,
    )
    linked = F.lit(True)
    for test in reversed(tests):
        linked = F.when(test, linked).otherwise(False)
    return a.join(b, (F.col("a_key") == F.col("b_key")) & linked).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with one more column, a key that names a row's document, and that column's name.

    The key is the id; for ids that come several times it is a 64-bit hash of id and text, for null ids it is null.
    """
    marked, shared = with_shared(docs, id_col)
    (key,) = fresh(marked, "_key")
    ids, kind = F.col(id_col), docs.schema[id_col].dataType
    kind = "bigint" if isinstance(kind, IntegralType) else kind.simpleString()
    named = F.when(ids.isNotNull() & F.col(shared), F.xxhash64(id_col, text_col).cast(kind)).otherwise(ids.cast(kind))
    return marked.select(*(marked[c] for c in docs.columns), named.alias(key)), key


def _classed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, class_id) of each row of docs (key, doc_id, text)."""
    sketched = materialise(_sketches(docs), "near-sketches")
    worded = sketched.where(F.col("key").isNotNull() & (F.size("bands") > 0))
    copies = worded.groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    copies = materialise(copies, "near-copies")
    members = copies.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last")
    star = materialise_joined(members.join(buckets.select("key", "leader"), "key"), "near-star")
    pairs = star.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = materialise_joined(pairs, "near-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    bags = materialise_joined(_bags(docs.select(F.col("key").alias("doc_id"), "text"), ids), "near-bags")
    near = materialise_joined(_similarities(pairs, bags), "near-links")
    links = near.where(F.col("similarity") >= SIMILARITY)
    label = components(links)

    # Bucket members in another class than their leader: strangers. They may be linked to a member that isn't the leader.
    own = star.join(near.select(F.col("a").alias("rep"), F.col("b").alias("leader"), "similarity"), ["rep", "leader"])
    named = own.join(label.select(F.col("node").alias("rep"), F.col("label").alias("mine")), "rep", "left")
    named = named.join(label.select(F.col("node").alias("leader"), F.col("label").alias("theirs")), "leader", "left")
    named = named.select("key", "rep", "similarity", F.coalesce("mine", "rep").alias("mine"), F.coalesce("theirs", "leader").alias("theirs"))
    named = materialise_joined(named.withColumn("stranger", F.col("mine") != F.col("theirs")), "near-members")
    if not named.where("stranger").isEmpty():
        more = materialise_joined(_stranger_links(named, copies.select("rep", "bands"), bags), "near-rest")
        if not more.isEmpty():
            # The classes so far stand for their links.
            label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    named_copies = copies.join(label, copies.rep == label.node, "left").select("c1", "c2", "rep", "first", "n", F.coalesce("label", "rep").alias("class_id"))
    # Classes with a key that is no id are named by their smallest id.
    odd = materialise(named_copies.where("rep <> first").select("class_id").distinct(), "near-odd")
    if not odd.isEmpty():
        names = named_copies.join(odd, "class_id", "left_semi").groupBy("class_id").agg(F.min("first").alias("name"))
        named_copies = named_copies.join(names, "class_id", "left").withColumn("class_id", F.coalesce("name", "class_id"))
    # Contents with more than a 1/HUBS of all rows, fewer than HUBS, are broadcast, so that no group of copies is a hot key.
    limit = (copies.agg(F.sum("n")).first()[0] or 0) / HUBS
    many = F.broadcast(named_copies.where(F.col("n") > limit).select("c1", "c2", F.col("class_id").alias("hub")))
    rows = worded.select("key", "doc_id", "c1", "c2").join(many, ["c1", "c2"], "left")
    few = named_copies.where(F.col("n") <= limit).select("c1", "c2", "class_id")
    found = rows.where("hub IS NULL").drop("hub").join(few, ["c1", "c2"]).select("key", "doc_id", "class_id")
    found = found.unionByName(rows.where("hub IS NOT NULL").select("key", "doc_id", F.col("hub").alias("class_id")))
    alone = sketched.where(F.col("key").isNull() | (F.size("bands") == 0)).select("key", "doc_id", F.col("doc_id").alias("class_id"))
    id_type = docs.schema["doc_id"].dataType
    return found.select("key", "doc_id", F.col("class_id").cast(id_type).alias("class_id")).union(alone)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, the smallest id of all documents linked to it, itself included.

    Documents with the same words are copies. Null, empty and wordless texts are like nothing and in classes of their own; so
    are rows with a null id, whose class is null. Rows that share an id are documents of their own, each with the class of its
    text. Other columns are ignored, and an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed, key = _keyed(docs, "doc_id", "text")
    return _classed(keyed.select(F.col(key).alias("key"), "doc_id", "text")).select("doc_id", "class_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but for those whose text is in a class with a smaller id. Null ids stay.

    Of rows that share an id only those go whose own text is such a copy; rows of a class's smallest id all stay.
    """
    keyed, key = _keyed(docs, id_col, text_col)
    found = _classed(keyed.select(F.col(key).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    extra = found.where("doc_id <> class_id").select(F.col("key").alias("_extra")).distinct()
    return keyed.join(extra, keyed[key] == extra["_extra"], "left_anti").select(*(keyed[c] for c in docs.columns))
