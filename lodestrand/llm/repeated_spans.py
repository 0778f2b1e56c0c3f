"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a string of MATCH bytes that also starts earlier: in a document with a smaller id, or before
in the same one. The suffixes that are indexed start at anchors: each window of MATCH bytes picks the GRAM-byte string
inside it whose hash is smallest, so equal windows pick equal anchors, and about one position in 32 is one. An anchor's
entry stands for its run of windows: it has the run's bytes from the anchor on, which is the suffix as far as a match
of these windows can reach, then those before the anchor, backwards.

Each task keeps an index family of its documents' suffixes. A batch of texts becomes a suffix array, in the order of the
bytes; it is merge-scanned against the arrays there already, and suffixes that agree to the end of their run are marked as
repeats at the later place; what is new becomes a level, and levels of like size merge, so an entry is merged a
logarithmic number of times. Neighbours in the merged array whose common prefix is an anchor at least, but not the run,
are the borders of repeats, where only some windows agree. What a task has left over - the first places of its runs - goes
to the cluster's last merge: suffixes of other tasks meet there by 64-bit hashes of anchor and run, since the bytes
themselves would be several times the input in the shuffle. A run that repeats anywhere is thus sent once per
family at most, however many copies there are.

The windows of borders, and no others, are hashed one by one from the texts and compared in the same manner.

A document is a row with its id and text. Rows of one id with different texts are different documents: ids that come several
times get a second key, the hash of the text, which orders them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import fresh, with_shared
from .store import materialise, partitions
from .texts import SLICE_BYTES, U64, Texts, _powers, mix, slices

MATCH, GRAM = 100, 37
#: Anchors that a window chooses from: a power of two.
CHOICES = MATCH - GRAM + 1
#: Bytes of an entry in the suffix order: those from its anchor on, those before it, and the two lengths, which are never 0.
AFTER, BEFORE = MATCH, CHOICES - 1
SUFFIX = AFTER + BEFORE + 2
#: Entries of a task's family at most; a fuller one is handed on and a new one begun.
FAMILY = 150_000
#: Rows that a task hands to Spark at once.
BATCH_ROWS = 1 << 16
_ENTRY, _BORDER, _SIGNAL, _MARK = range(4)
_LEAST = np.iinfo(np.int64).min
_ODD = U64(0xD1342543DE82EF95)

Columns = tuple[np.ndarray, ...]


def entries(texts: Texts) -> Columns:
    """(suffix, anchor's hash, run's hash, text, first window, windows after it) of each run of windows with one anchor."""
    data = texts.data
    if len(data) < MATCH:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, f"S{SUFFIX}"), none.view(U64), none.view(U64), none, none, none
    sums = texts.prefix_hash()
    _, inverse = _powers(len(data))
    grams = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1]
    # The order of anchors is by 40 bits of their hash, then by place; a slice has fewer than 2**24 places.
    least = (grams * _ODD) >> U64(24) << U64(24) | np.arange(len(grams), dtype=U64)
    step = 1
    while step < CHOICES:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    anchor = (least & U64((1 << 24) - 1)).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, dtype=np.int32)
    long = np.flatnonzero(texts.sizes >= MATCH)
    edge[texts.bounds[long]] += 1
    np.add.at(edge, texts.bounds[long + 1] - MATCH + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    change = anchor[1:] != anchor[:-1]
    begins, stops = valid.copy(), valid.copy()
    begins[1:] &= change | ~valid[:-1]
    stops[:-1] &= change | ~valid[1:]
    low, high = np.flatnonzero(begins), np.flatnonzero(stops)
    at = anchor[low]
    context = texts.hashes(sums, low, high + MATCH)
    context = mix(context + (at - low).astype(U64) * _ODD)
    text = texts.owner(low)
    return _suffixes(data, at, low, high + MATCH), mix(grams[at]), context, text, low - texts.bounds[text], high - low


def _suffixes(data: np.ndarray, at: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each run [low, end) with its anchor at `at`: the bytes that order it, as one fixed-length string."""
    out = np.zeros((len(at), SUFFIX), dtype=np.uint8)
    after, before = end - at, at - low
    k = np.arange(AFTER)
    out[:, :AFTER] = np.where(k < after[:, None], data[np.minimum(at[:, None] + k, len(data) - 1)], 0)
    k = np.arange(BEFORE)
    out[:, AFTER : AFTER + BEFORE] = np.where(k < before[:, None], data[np.maximum(at[:, None] - 1 - k, 0)], 0)
    out[:, -2], out[:, -1] = after, before + 1
    return out.reshape(-1).view(f"S{SUFFIX}")


def _segments(column: pa.Array) -> Iterator[tuple[Texts, int, int]]:
    """Slices, and of a text longer than a slice its overlapping parts: (texts, first row, offset in the text)."""
    for part in slices(column):
        if len(part.data) <= SLICE_BYTES or len(part) > 1:
            yield part, part.row, 0
            continue
        for start in range(0, max(1, len(part.data) - MATCH + 1), SLICE_BYTES):
            piece = part.data[start : start + SLICE_BYTES + MATCH - 1]
            yield Texts(piece, np.array([0, len(piece)]), part.row), part.row, start


def _merged(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> Columns:
    """Byte ranges joined where they touch, by document."""
    if not len(doc):
        return doc, tie, start, end
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    # Ends are made to grow across documents, so that one running maximum serves all.
    group = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = start[1:] + group[1:] * span > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], tie[first], start[first], reach[last] - group[last] * span


def _later(place: Columns, than: Columns) -> np.ndarray:
    """Whether places (document, tie, start) come after others."""
    (doc, tie, at), (than_doc, than_tie, than_at) = place, than
    same = doc == than_doc
    return (doc > than_doc) | same & (tie > than_tie) | same & (tie == than_tie) & (at > than_at)


def _at(columns: Columns, rows: np.ndarray) -> Columns:
    return tuple(x[rows] for x in columns)


def _heads(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: whether each is the first with its values, and where that first one is."""
    head = np.ones(len(columns[0]), dtype=bool)
    if len(head):
        head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return head, np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))


class Family:
    """Suffix arrays with distinct runs, in sizes that fall geometrically; and the repeats found so far."""

    def __init__(self):
        #: Of each level: suffix, anchor, run, document, tie, first window, windows after it; in the order of the suffixes.
        self.levels: list[Columns] = []
        self.marks: list[Columns] = []

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def _mark(self, doc: np.ndarray, tie: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
        self.marks.append(_merged(doc, tie, at, at + more + MATCH))

    def add(self, *batch: np.ndarray) -> None:
        """Columns as in a level, in any order."""
        new = _at(batch, np.lexsort((batch[5], batch[4], batch[3], batch[0])))
        head, first = _heads(new[0])
        again = ~head & _later(new[3:6], _at(new[3:6], first))
        self._mark(*_at(new[3:], again))
        new = _at(new, head)
        for level in self.levels:
            place = np.minimum(np.searchsorted(level[0], new[0]), len(level[0]) - 1)
            known = level[0][place] == new[0]
            mine, theirs = np.flatnonzero(known), place[known]
            later = _later(_at(new[3:6], mine), _at(level[3:6], theirs))
            self._mark(*_at(new[3:], mine[later]))
            # An earlier place takes over, and the one so far is a repeat.
            mine, theirs = mine[~later], theirs[~later]
            moved = _later(_at(level[3:6], theirs), _at(new[3:6], mine))
            mine, theirs = mine[moved], theirs[moved]
            self._mark(*_at(level[3:], theirs))
            for k in (3, 4, 5):
                level[k][theirs] = new[k][mine]
            new = _at(new, ~known)
        if len(new[0]):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge()

    def _merge(self) -> None:
        both = [np.concatenate(x) for x in zip(self.levels.pop(), self.levels.pop())]
        self.levels.append(_at(both, np.argsort(both[0], kind="stable")))

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        """Rows (at, ctx, doc, tie, meta) for the cluster's merge, and an empty family.

        An anchor with several runs here is a border for sure: its entries are sent by run, which spreads them,
        and one signal row by the anchor tells the other tasks.
        """
        while len(self.levels) > 1:
            self._merge()
        if self.levels:
            suffix, *columns = self.levels.pop()
            # Neighbours with a common prefix as long as an anchor have the same one: all the array's runs are distinct.
            gram = suffix.view(np.uint8).reshape(-1, SUFFIX)[:, :GRAM]
            near = (gram[1:] == gram[:-1]).all(axis=1)
            border = np.append(near, False) | np.append(False, near)
            # By place: neighbours' rows are alike, and shuffle files small.
            order = np.lexsort((columns[4], columns[3], columns[2]))
            border, (anchor, context, doc, tie, at, more) = border[order], _at(columns, order)
            key = np.where(border, mix(context), anchor).view(np.int64)
            yield from _dealt(_rows(key, context.view(np.int64), doc, tie, at << 16 | more << 8 | np.where(border, _BORDER, _ENTRY)))
            signals = np.unique(anchor[border]).view(np.int64)
            same = lambda value: np.full(len(signals), value, dtype=np.int64)
            yield _rows(signals, same(_LEAST), same(0), same(0), same(_SIGNAL))
        if self.marks:
            doc, tie, start, end = _merged(*(np.concatenate(x) for x in zip(*self.marks)))
            yield from _dealt(_rows(mix(doc.view(U64) ^ tie.view(U64)).view(np.int64), end, doc, tie, start << 16 | _MARK))
        self.__init__()


def _dealt(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), BATCH_ROWS):
        yield rows.slice(k, BATCH_ROWS)


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "ctx", "doc", "tie", "meta"])


def _ranges(doc: np.ndarray, tie: np.ndarray, a: np.ndarray, b: np.ndarray, border: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(tie), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.full(len(doc), border))],
        ["doc", "tie", "a", "b", "border"],
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = Family()
    for batch in batches:
        ids, ties = (batch.column(k).to_numpy() for k in (0, 1))
        for part, row, offset in _segments(batch.column(2)):
            suffix, anchor, context, text, at, more = entries(part)
            if len(anchor):
                family.add(suffix, anchor, context, ids[row + text], ties[row + text], at + offset, more)
            if len(family) > FAMILY:
                yield from family.hand_on()
    yield from family.hand_on()


def _merge_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats and border runs from rows sorted by (at, ctx, doc, tie, meta). Only the last run's first row is kept."""
    kept, several, sent = None, False, False
    for batch in batches:
        rows = tuple(c.to_numpy() for c in batch.columns)
        mark = rows[4] & 0xFF == _MARK
        if mark.any():
            _, end, doc, tie, meta = _at(rows, mark)
            yield _ranges(doc, tie, meta >> 16, end, False)
            rows = _at(rows, ~mark)
        if not len(rows[0]):
            continue
        if kept is not None:
            rows = tuple(np.insert(x, 0, k) for x, k in zip(rows, kept))
        at, ctx, doc, tie, meta = rows
        kind, more, first_window = meta & 0xFF, meta >> 8 & 0xFF, meta >> 16
        head, first = _heads(at, ctx)
        place = (doc, tie, first_window)
        again = ~head & (kind != _SIGNAL) & _later(place, _at(place, first))
        yield _ranges(*_at(place, again), (first_window + more + MATCH)[again], False)
        new_at, _ = _heads(at)
        group = np.cumsum(new_at) - 1
        contexts = np.bincount(group, head)
        contexts[0] += several
        border = head & (kind != _SIGNAL) & ((contexts[group] > 1) | (kind == _BORDER))
        border[0] &= not sent
        yield _ranges(*_at(place, border), (first_window + more)[border], True)
        k = first[-1]
        kept, several = tuple(x[k] for x in rows), bool(contexts[group[k]] > 1)
        sent = several or kind[k] == _BORDER


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, doc, tie, p, e): hashes of border windows, each once per batch at its first place (e = 0), and ranges of repeats.

    Batches are (doc, tie, text, runs).
    """
    for batch in batches:
        ids, ties, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        offsets, flat = np.asarray(lists.offsets), lists.values
        low, high = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        found = []
        for part in slices(batch.column(2)):
            sums = part.prefix_hash()
            a, b = offsets[part.row], offsets[part.row + len(part)]
            text = np.repeat(np.arange(len(part)), np.diff(offsets[part.row : part.row + len(part) + 1]))
            n = high[a:b] - low[a:b] + 1
            p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low[a:b], n)
            text = np.repeat(text, n)
            start = p + part.bounds[text]
            found.append((part.hashes(sums, start, start + MATCH).view(np.int64), ids[part.row + text], ties[part.row + text], p))
        if not found:
            continue
        w, *place = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((*reversed(place), w))
        w, place = w[order], _at(place, order)
        head, first = _heads(w)
        again = ~head & _later(place, _at(place, first))
        by_place = np.flatnonzero(head)[np.argsort(order[head])]
        yield from _dealt(_window_rows(w[by_place], *_at(place, by_place), np.zeros(len(by_place), np.int64)))
        doc, tie, start, end = _merged(*_at(place, again), place[2][again] + MATCH)
        yield _window_rows(mix(doc.view(U64) ^ tie.view(U64)).view(np.int64), doc, tie, start, end)


def _window_rows(w: np.ndarray, doc: np.ndarray, tie: np.ndarray, p: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(w), pa.array(doc), pa.array(tie), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["w", "doc", "tie", "p", "e"])


def _window_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats from rows sorted by (w, doc, tie, p)."""
    kept = None
    for batch in batches:
        rows = tuple(c.to_numpy() for c in batch.columns)
        mark = rows[4] > 0
        yield _ranges(*_at(rows[1:], mark), False)
        rows = _at(rows[:4], ~mark)
        if not len(rows[0]):
            continue
        if kept is not None:
            rows = tuple(np.insert(x, 0, k) for x, k in zip(rows, kept))
        w, *place = rows
        head, first = _heads(w)
        again = ~head & _later(place, _at(place, first))
        start = place[2][again].astype(np.int64)
        yield _ranges(*_merged(place[0][again], place[1][again], start, start + MATCH), False)
        kept = tuple(x[first[-1]] for x in rows)


_FOUND = "doc bigint, tie bigint, a int, b int, border boolean"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with two more columns, document and tie, that name a row's document; and their names.

    The tie is 0 but for rows with a null id and ids that come several times.
    """
    marked, shared = with_shared(docs, id_col)
    doc, tie = fresh(marked, "_doc", "_tie")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return marked.select(
        *(marked[c] for c in docs.columns), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias(doc),
        F.when(F.col(shared), text_hash).otherwise(F.lit(0)).alias(tie),
    ), doc, tie


def _with_list(docs: DataFrame, key: tuple[str, str], found: DataFrame, name: str) -> DataFrame:
    """docs, and each document's list of ranges (null without any) as the last column.

    Lists are a small part of their documents' bytes, and their side of the join is the one that is built.
    """
    d, t = key
    lists = found.groupBy("doc", "tie").agg(F.collect_list(F.struct("a", "b")).alias(name)).hint("shuffle_hash")
    return docs.join(lists, (docs[d] == lists["doc"]) & (docs[t] == lists["tie"]), "left").select(*(docs[c] for c in docs.columns), lists[name])


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, and as the last one the byte ranges [a, b) of each text that are to go; ranges may overlap.

    Ids are integers. Null ids come before all others. Rows of one id, or without one, are different documents if their texts
    differ, in the order of the texts' hashes; with the same text they are one document, given several times. Null
    texts are empty. Columns of any names are kept, and an empty table gives no rows. A text of any length is handled in
    parts. Texts are shuffled once: both joins read the same exchange, which is why the first keeps all rows and columns.
    """
    n = partitions(docs.sparkSession)
    keyed, doc, tie = _keyed(docs, id_col, text_col)
    texts = keyed.select(doc, tie, F.col(text_col))
    left_over = texts.mapInArrow(_index, "at bigint, ctx bigint, doc bigint, tie bigint, meta bigint")
    found = materialise(
        left_over.repartition(n, "at").sortWithinPartitions("at", "ctx", "doc", "tie", "meta").mapInArrow(_merge_scan, _FOUND), "repeats"
    )
    dealt = keyed.repartition(n, doc, tie)
    (name,) = fresh(keyed, "_ranges")
    places = [dealt.columns.index(c) for c in (doc, tie, text_col)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(batch.column(batch.num_columns - 1).is_valid())
            columns = [some.column(k) for k in (*places, some.num_columns - 1)]
            yield from _windows(iter([pa.RecordBatch.from_arrays(columns, ["doc", "tie", "text", "runs"])]))

    windows = _with_list(dealt, (doc, tie), found.where("border"), name).mapInArrow(hashed, "w bigint, doc bigint, tie bigint, p int, e int")
    partly = windows.repartition(n, "w").sortWithinPartitions("w", "doc", "tie", "p").mapInArrow(_window_scan, _FOUND)
    everything = _with_list(dealt, (doc, tie), found.where("not border").union(partly), name)
    return everything.select(*(everything[c] for c in docs.columns), everything[name])


def _kept(part: Texts, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The remaining bytes of some texts, their bounds, and each text's number of removed runs."""
    lists = lists.fill_null([])
    offsets, flat = np.asarray(lists.offsets), lists.values
    a, b = offsets[part.row], offsets[part.row + len(part)]
    text = np.repeat(np.arange(len(part)), np.diff(offsets[part.row : part.row + len(part) + 1]))
    edge = np.zeros(len(part.data) + 1, dtype=np.int32)
    for k, sign in ((0, 1), (1, -1)):
        at = flat.field(k).to_numpy(zero_copy_only=False)[a:b].astype(np.int64) + part.bounds[text]
        np.add.at(edge, np.minimum(at, part.bounds[text + 1]), sign)
    gone = np.cumsum(edge[:-1]) > 0
    spans = np.bincount(part.runs_where(gone)[2], minlength=len(part))
    return part.data[~gone], np.append(0, np.cumsum(~gone))[part.bounds], spans


def remaining(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Null ids and texts, repeated rows and ids, long texts and empty tables: as in `with_repeats`. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                data, bounds, spans = _kept(part, batch.column(2))
                kept = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.row, len(part)), pa.array(part.sizes), pa.array(part.sizes - np.diff(bounds)), pa.array(spans),
                     kept.cast(pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return with_repeats(docs).mapInArrow(run, schema)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with texts that have lost their repeated bytes.

    Characters of which a part went go whole. Texts without repeats, nulls among them, stay as they are. Null ids,
    repeated rows and ids, long texts, columns of any names and empty tables: as in `with_repeats`.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for part in slices(batch.column(place)):
                data, bounds, spans = _kept(part, batch.column(batch.num_columns - 1))
                old = batch.column(place).slice(part.row, len(part)).to_pylist()
                raw = data.tobytes()
                for k, text in enumerate(old):
                    texts.append(raw[bounds[k] : bounds[k + 1]].decode("utf-8", "ignore") if spans[k] else text)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return with_repeats(docs, id_col, text_col).mapInArrow(run, docs.schema)
