"""Alignment of two tokenizers over the same texts, each distinct segment once.

Texts are cut before whitespace runs that begin with a space, where neither vocabulary can merge across: the byte-level one's
pre-tokenizer always cuts there, and no piece of the other has a space behind something else (`safe_cuts` looks). A block is some
MB of texts as numbers of its distinct segments. Its segments are rows that meet by their bytes, sorted, so that a
segment that comes in any number of blocks is tokenized and aligned in one place and once; the alignments go back to
the blocks, which compose their documents. Counts of linked id pairs are summed over the blocks and come back the same way, one
row per block and distinct pair, so a frequent segment or pair has as many rows as there are blocks, not as there are documents.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import SMALL_BATCHES, materialise, partitions, scratch
from .texts import Texts, slices

#: Bytes of text in a block, and at once while segments are looked for; a longer text makes a block of its own.
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Segments that are tokenized at once, alignments that are sorted by block and packed at once, and references whose links are counted at once.
_TOKENIZED, _PACKED, _COUNTED = 20_000, 400_000, 150_000
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
STATISTICS = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """Both tokenizers with the bytes of their tokens. Special tokens' strings are plain text."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        path = lambda p: p if os.sep in p else public_tokenizers.path(p)
        self.a, self.b = Tokenizer.from_file(path(a)), sentencepiece.SentencePieceProcessor(model_file=path(b))
        self.a.encode_special_tokens = True
        byte = {c: bytes([k]) for k, c in enumerate(_byte_letters())}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = b"".join(byte.get(c, c.encode()) for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = ([str(k) for k in range(len(t))] for t in (self.a_bytes, self.b_bytes))
        self.safe_cuts = self._safe(json.loads(self.a.to_str()), pieces)

    def _safe(self, a: dict, pieces: list[str]) -> bool:
        """Whether texts may be cut before a space that follows something else than white space."""
        splits = a.get("pre_tokenizer") or {}
        cut_by_a = a.get("normalizer") is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        return bool(cut_by_a) and not any(x != "▁" and y == "▁" for p in pieces for x, y in zip(p, p[1:]))

    def align(self, segments: list[str]) -> list[tuple[str, bytes] | None]:
        """Of each segment, a space before it: groups as text, and a step for each link; None if bytes differ.

        A step says whether the link has the next token of a (1), of b (2), or of both (3).
        """
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        ids_b = self.b.encode(segments, num_threads=1)
        raw = [(" " + s).encode() for s in segments]
        joined = lambda table, ids: b"".join(map(table.__getitem__, ids))
        good = [k for k, x in enumerate(raw) if joined(self.a_bytes, ids_a[k]) == x == joined(self.b_bytes, ids_b[k])]
        out: list[tuple[str, bytes] | None] = [None] * len(segments)
        if not good:
            return out
        # All good segments one after another: bytes agree, so ends of tokens do across them.
        flat_a, flat_b = (np.fromiter((i for k in good for i in ids[k]), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.a_sizes[flat_a]), np.cumsum(self.b_sizes[flat_b])
        # Each stretch between two ends, of either, is in one token of a and one of b: a link.
        stretches = np.union1d(ends_a, ends_b)
        steps = sum(k * np.diff(np.searchsorted(e, stretches), prepend=-1) for k, e in ((1, ends_a), (2, ends_b))).astype(np.uint8).tobytes()
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = (np.searchsorted(e, both) + 1 for e in (ends_a, ends_b))
        names_a, names_b = [self.a_names[i] for i in flat_a.tolist()], [self.b_names[i] for i in flat_b.tolist()]
        groups, x, y = [], 0, 0
        for p, q in zip(to_a.tolist(), to_b.tolist()):
            groups.append(f"{names_a[x] if p == x + 1 else ','.join(names_a[x:p])}|{names_b[y] if q == y + 1 else ','.join(names_b[y:q])}")
            x, y = p, q
        segment_ends = np.cumsum([len(raw[k]) for k in good])
        last_group, last_link = (np.searchsorted(at, segment_ends) + 1 for at in (both, stretches))
        g = n = 0
        for k, group_end, link_end in zip(good, last_group.tolist(), last_link.tolist()):
            out[k] = (";".join(groups[g:group_end]), steps[n:link_end])
            g, n = group_end, link_end
        return out


def _byte_letters() -> list[str]:
    """The letters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(k) if k in printable else chr(next(others)) for k in range(256)]


@lru_cache(maxsize=2)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


# --- blocks ---------------------------------------------------------------------------------------------------------


def _cuts(texts: Texts) -> np.ndarray:
    """Places of spaces behind something that isn't white space in the same text, but for a text's last byte."""
    data = texts.data
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    solid = (data > 0x20) & (data != 0x7F)
    # Last bytes of white space beyond ASCII: U+0085, U+00A0, and those of three bytes, with some that aren't any, which does no harm.
    first, second = np.concatenate([[0], data[:-1]]), np.concatenate([[0, 0], data[:-2]])
    solid &= ~((first == 0xC2) & ((data == 0x85) | (data == 0xA0)))
    thirds = (second == 0xE2) & (first == 0x80) & (((data >= 0x80) & (data <= 0x8F)) | ((data >= 0xA8) & (data <= 0xAF)))
    thirds |= ((second == 0xE2) & (first == 0x81)) | ((second == 0xE1) & ((first == 0x9A) | (first == 0xA0)))
    thirds |= ((second == 0xE3) & (first == 0x80)) | ((second == 0xEF) & (first == 0xBB))
    solid &= ~thirds
    at = np.flatnonzero((data[1:] == 0x20) & solid[:-1]) + 1
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[texts.bounds] = True
    return at[~edge[at] & ~edge[at + 1]]


def _segments(texts: Texts, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of segments, without the space that each begins with (the first one's is the space added)."""
    full = np.flatnonzero(texts.sizes)
    at = _cuts(texts) if cut else np.zeros(0, dtype=np.int64)
    starts = np.sort(np.concatenate([texts.bounds[:-1][full], at + 1]))
    ends = np.sort(np.concatenate([texts.bounds[1:][full], at]))
    return starts, ends, texts.owner(starts)


class _Block:
    """Texts of one block as numbers of distinct segments."""

    def __init__(self):
        self.size, self.doc_ids, self.counts, self.hashes, self.strings, self.refs, self.n = 0, [], [], [], [], [], 0

    def add(self, texts: Texts, doc_ids: pa.Array, cut: bool) -> None:
        starts, ends, owner = _segments(texts, cut)
        hashes = texts.hashes(texts.prefix_hash(), starts, ends)
        distinct, where, refs = np.unique(hashes, return_index=True, return_inverse=True)
        raw = texts.data.tobytes()
        self.strings.append(np.array([raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())], dtype=object))
        self.hashes.append(distinct)
        self.refs.append((refs + self.n).astype(np.uint32))
        self.n += len(distinct)
        self.doc_ids.append(doc_ids)
        self.counts.append(np.bincount(owner, minlength=len(texts)).astype(np.uint32))
        self.size += len(texts.data)

    def row(self, block: int) -> pa.RecordBatch:
        _, where, merged = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        ids, refs = pa.concat_arrays(self.doc_ids), merged.astype(np.uint32)[np.concatenate(self.refs)]
        # The most frequent first, so that most numbers are small and pack well.
        order = np.argsort(-np.bincount(refs, minlength=len(where)), kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        refs = rank[refs]
        strings = pa.array(np.concatenate(self.strings)[where[order]].tolist(), pa.binary()).cast(pa.string())
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), one(ids), pa.array([packed(np.concatenate(self.counts), refs)], pa.binary()), one(strings)],
            ["block", "doc_ids", "docs", "segs"],
        )


def _planes(numbers: np.ndarray) -> bytes:
    """The bytes of unsigned 32-bit numbers, plane by plane."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays of unsigned 32-bit numbers, and bytes, compressed together."""
    raw = [x if isinstance(x, bytes) else _planes(x) for x in parts]
    sizes = np.array([sum(map(len, raw)), *map(len, raw)], dtype="<u4").tobytes()
    return bytes([len(raw)]) + sizes + pa.Codec("zstd", 3).compress(b"".join(raw), asbytes=True)


def unpacked(blob: bytes) -> list[bytes]:
    total, *sizes = np.frombuffer(blob, "<u4", blob[0] + 1, 1).tolist()
    raw, ends = pa.Codec("zstd").decompress(blob[5 + 4 * len(sizes) :], decompressed_size=total, asbytes=True), np.cumsum(sizes).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes)]


def _blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(block, doc_ids, docs, segs): of each document how many segments, and their numbers among the block's distinct ones, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nth, cut = _Block(), TaskContext.get().partitionId() << 32, pair(a, b).safe_cuts
        for batch in batches:
            for texts in slices(batch.column(1), SLICE_BYTES):
                if block.size and block.size + len(texts.data) > BLOCK_BYTES:
                    yield block.row(nth)
                    block, nth = _Block(), nth + 1
                block.add(texts, batch.column(0).slice(texts.row, len(texts)), cut)
        if block.doc_ids:
            yield block.row(nth)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"block bigint, doc_ids array<{kind}>, docs binary, segs array<string>")


def _alignments(blocks: DataFrame, a: str, b: str) -> DataFrame:
    """(block, segments): alignments of a block's segments, some of them packed in one row. Groups are empty where bytes differ."""

    def rows(blocks_: np.ndarray, refs: np.ndarray, which: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
        order = np.argsort(blocks_, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks_[order], prepend=blocks_[order[:1]] - 1))
        out = []
        for mine in np.split(order, cuts[1:]):
            groups, steps = zip(*(found[k] for k in which[mine].tolist()))
            out.append(packed(refs[mine], np.array([len(x) for x in steps]), b"".join(steps), "\n".join(groups).encode()))
        return pa.RecordBatch.from_arrays([pa.array(blocks_[order[cuts]]), pa.array(out, pa.binary())], ["block", "segments"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, empty = pair(a, b), ("", b"")
        last, found, held = None, [empty], []
        for batch in batches:
            for k in range(0, len(batch), _TOKENIZED):
                part = batch.slice(k, _TOKENIZED)
                segments = part.column(2).to_pylist()
                fresh = [s != before for s, before in zip(segments, [last, *segments])]
                which = len(found) - 1 + np.cumsum(fresh)
                found += [r or empty for r in both.align([s for s, new in zip(segments, fresh) if new])]
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), which))
                last = segments[-1]
                if sum(len(h[2]) for h in held) >= _PACKED:
                    yield rows(*(np.concatenate(x) for x in zip(*held)), found)
                    found, held = found[-1:], []
        if held:
            yield rows(*(np.concatenate(x) for x in zip(*held)), found)

    seen = blocks.select("block", F.posexplode("segs").alias("ref", "seg"))
    met = seen.repartition(partitions(blocks.sparkSession), "seg").sortWithinPartitions("seg")
    return met.mapInArrow(run, "block bigint, segments binary")


# --- documents --------------------------------------------------------------------------------------------------------


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many values each."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts, dtype=np.int64)
    return total[ends] - total[ends - counts]


def _pair_documents(docs: np.ndarray, refs: np.ndarray, ends: np.ndarray, links: np.ndarray, n_pairs: int) -> np.ndarray:
    """In how many of some documents each pair is linked."""
    owner, ref = np.divmod(np.unique(docs * len(ends) + refs), len(ends))
    sizes = np.diff(ends, prepend=0)[ref]
    at = np.arange(sizes.sum()) + np.repeat(ends[ref] - np.cumsum(sizes), sizes)
    return np.bincount(np.unique(np.repeat(owner, sizes) * n_pairs + links[at]) % n_pairs, minlength=n_pairs)


def _stretches(counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Documents [d, e) and their references [r, s), some _COUNTED references at a time; a document is never divided."""
    ends, d = np.cumsum(counts), 0
    while d < len(counts):
        r = int(ends[d - 1]) if d else 0
        e = max(d + 1, int(np.searchsorted(ends, r + _COUNTED, side="right")))
        yield d, e, r, int(ends[e - 1])
        d = e


_BLANKS = bytes.maketrans(b",|;\n", b"    ")


def _read_groups(groups: list[str], steps: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups as text: tokens of a and of b in each, and all links by their steps."""
    full = np.flatnonzero([bool(g) for g in groups])
    raw = "\n".join([groups[k] for k in full.tolist()]).encode()
    ids = np.fromstring(raw.translate(_BLANKS), dtype=np.int64, sep=" ") if raw else np.zeros(0, np.int64)
    signs = np.frombuffer(raw, np.uint8)
    signs = signs[(signs < 0x30) | (signs > 0x39)]
    # Behind each id but the last stands a sign; b's ids stand between a bar and the group's end.
    before = lambda marks: np.concatenate(([0], np.cumsum(marks)))[: len(ids)]
    is_b = before(signs == 0x7C) > before((signs == 0x3B) | (signs == 0x0A))
    owner = full[before(signs == 0x0A)]
    counts = [np.bincount(owner[side], minlength=len(groups)) for side in (~is_b, is_b)]
    links = ids[~is_b][np.cumsum(steps & 1) - 1] * n_b + ids[is_b][np.cumsum(steps >> 1) - 1]
    return counts[0], counts[1], links


def _composed(blocks: DataFrame, alignments: DataFrame, kind: str, n_b_ids: int) -> DataFrame:
    """One row per block: its documents' statistics, and its segments' links as numbers of its distinct pairs, for the scores."""

    def run(block: pa.Table, segments: pa.Table) -> pa.Table:
        counts, refs = (_numbers(x) for x in unpacked(block["docs"][0].as_py()))
        counts = counts.astype(np.int64)
        parts = [unpacked(x.as_py()) for x in segments["segments"]]
        column = lambda k: np.concatenate([_numbers(p[k]) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        place, sizes = column(0), column(1)
        steps = np.frombuffer(b"".join(p[2] for p in parts), np.uint8).astype(np.int64)
        groups = [g for p in parts for g in p[3].decode().split("\n")]
        n_a, n_b, links = _read_groups(groups, steps, n_b_ids) if groups else (sizes, sizes, sizes)
        order = np.argsort(place)
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        links = links[np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]
        groups, n_a, n_b = [groups[k] for k in order.tolist()], n_a[order], n_b[order]
        n_groups = np.array([g.count("|") for g in groups], dtype=np.int64)
        pairs, local = np.unique(links, return_inverse=True)
        link_ends, n_docs = np.cumsum(sizes), np.zeros(len(pairs), np.int64)
        stats, good, hashes = np.zeros((4, len(counts)), np.int64), np.ones(len(counts), bool), []
        for d, e, r, s in _stretches(counts):
            here, n = refs[r:s].astype(np.int64), counts[d:e]
            good[d:e] = _sums((n_groups[here] == 0).astype(np.int64), n) == 0
            for k, x in enumerate((n_a, n_b, n_groups, sizes)):
                stats[k, d:e] = np.where(good[d:e], _sums(x[here], n), 0)
            names, end = here.tolist(), 0
            for m, fine in zip(n.tolist(), good[d:e].tolist()):
                end += m
                hashes.append(hashlib.sha256(";".join([groups[k] for k in names[end - m : end]]).encode()).hexdigest() if fine and m else "")
            kept = np.repeat(good[d:e], n)
            if kept.any():
                n_docs += _pair_documents(np.repeat(np.arange(e - d), n)[kept], here[kept], link_ends, local, len(pairs))
        one = lambda x, t: pa.array([x.tolist() if isinstance(x, np.ndarray) else x], pa.list_(t))
        return pa.table({
            "block": block["block"], "doc_ids": block["doc_ids"], "docs": block["docs"], **{c: one(x, pa.int64()) for c, x in zip(STATISTICS, stats)},
            "good": one(good, pa.bool_()), "groups_sha256": one(hashes, pa.string()), "links": pa.array([packed(sizes, local)], pa.binary()),
            "pairs": one(pairs, pa.int64()), "pair_docs": one(n_docs, pa.int64()),
        })

    fields = ", ".join(f"{c} array<bigint>" for c in STATISTICS)
    schema = (
        f"block bigint, doc_ids array<{kind}>, docs binary, {fields}, good array<boolean>, groups_sha256 array<string>, links binary, "
        "pairs array<bigint>, pair_docs array<bigint>"
    )
    plain = blocks.select("block", "doc_ids", "docs")
    return plain.groupBy("block").cogroup(alignments.groupBy("block")).applyInArrow(run, schema)


def pair_counts(composed: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents a and b are linked, and whether no other b of that a is in more."""
    counts = composed.select(F.inline(F.arrays_zip("pairs", "pair_docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_docs").alias("n"))
    # At most as many rows of one a as b has ids.
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"pair div {n_b}"))))


def _scored(composed: DataFrame, scores: DataFrame, kind: str) -> DataFrame:
    def run(block: pa.Table, pairs: pa.Table) -> pa.Table:
        counts, refs = (_numbers(x) for x in unpacked(block["docs"][0].as_py()))
        sizes, links = (_numbers(x) for x in unpacked(block["links"][0].as_py()))
        counts, scores = counts.astype(np.int64), np.zeros((2, len(pairs)), np.int64)
        scores[:, pairs["nth"].to_numpy()] = pairs["best"].to_numpy(), pairs["n"].to_numpy()
        by_segment = [_sums(x[links], sizes) for x in scores]
        out = np.zeros((2, len(counts)), np.int64)
        for d, e, r, s in _stretches(counts):
            for k, x in enumerate(by_segment):
                out[k, d:e] = _sums(x[refs[r:s]], counts[d:e]) if len(x) else 0
        column = lambda c: block[c].combine_chunks().values
        out *= np.array(column("good"))
        stats = {c: column(c) for c in STATISTICS}
        return pa.table({"doc_id": column("doc_ids"), **stats, "n_best": out[0], "count_sum": out[1], "groups_sha256": column("groups_sha256")})

    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in STATISTICS)}, n_best bigint, count_sum bigint, groups_sha256 string"
    named = composed.drop("pairs", "pair_docs")
    return named.groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(run, schema)


def align(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those of which a tokenizer's bytes differ from a space and the text, have no tokens: zeros and ''.
    Texts of any length count whole, rows that share an id or have none are documents of their own, other columns are ignored.
    """
    n_b = len(pair(a, b).b_bytes)
    if n_b * len(pair(a, b).a_bytes) > 1 << 32:
        raise ValueError("pairs of ids must fit 32 bits")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession) as tables:
        blocks = materialise(_blocks(plain, a, b), "segment-blocks", **SMALL_BATCHES)
        composed = materialise(_composed(blocks, _alignments(blocks, a, b), kind, n_b), "composed-blocks")
        tables.pop()
    counts = materialise(pair_counts(composed, n_b), "pair-counts")
    held = composed.select("block", F.posexplode("pairs").alias("nth", "pair"))
    scores = held.join(counts, "pair").select(F.col("block").alias("of"), "nth", "n", F.col("best").cast("long").alias("best"))
    return _scored(composed, scores, kind)
