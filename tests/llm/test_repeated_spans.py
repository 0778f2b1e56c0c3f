import hashlib
import random

import pytest

from lodestrand.llm import repeated_spans as R
from lodestrand.llm.queries import QUERIES


def brute(rows, order=len):
    """By document: bytes, removed, runs, kept. A document is an id with a text; `order` ranks the texts of an id."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, order(x[1]))):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(raw[p : p + 100])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i, t] = len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept
    return out


def test_query_is_brute_force(spark, small, small_docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_family"](spark, small).collect()}
    want = {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for (i, _), x in brute(small_docs).items()}
    assert sum(x[1] for x in want.values()) and got == want


@pytest.mark.parametrize("seed", range(3))
def test_spliced_texts(spark, seed):
    """Passages of about the limit in all kinds of neighbourhoods, low-entropy texts, overlaps with themselves."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcé ", k=rng.randint(60, 180))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(passages), "ab" * rng.randint(1, 90), "".join(rng.choices("abcdefgh ", k=rng.randint(0, 90)))]) for _ in range(rng.randint(0, 7))]
        rows.append((rng.randint(-50, 50) * 100 + i, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in R.remaining(docs).collect()}
    assert got == {i: x for (i, _), x in brute(rows).items()}


def hashes(spark, rows):
    texts = sorted({t or "" for _, t in rows})
    return {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}


def by_row(docs, rows):
    """(id, result) of each row."""
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in R.remaining(docs).collect())


def test_rows_that_share_an_id(spark, words):
    """Also rows without an id, the same passage at the same place, and repeated rows."""
    a, b, c = words(60, 31), words(60, 32), words(90, 33)
    rows = [(1, a), (2, a + b), (2, c), (2, c + a), (2, a + c), (3, a + words(9, 34)), (3, a + words(9, 35)), (None, a), (None, b + a), (None, a), (4, b), (4, b), (5, c)]
    want = brute(rows, hashes(spark, rows).__getitem__)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert by_row(docs, rows) == sorted(repr((i, *want[i, t])) for i, t in rows)
    kept = {(r.doc_id, r.text) for r in R.cut(docs).where("doc_id = 5").collect()}
    assert kept == {(5, "")}


def test_many_families(spark, words, monkeypatch):
    """Small families and slices in one process: levels merge, are handed on, and the last merge finds the rest."""
    import pyarrow as pa

    passages = [words(40, k) for k in range(8)]
    rows = [(k, " ".join([passages[k % 8], words(30, 100 + k), passages[k * 3 % 8][:150]])) for k in range(60)]
    monkeypatch.setattr(R, "FAMILY", 300)
    monkeypatch.setattr(R, "BATCH_ROWS", 50)
    texts = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], ["doc", "tie", "text"])
    out = [r for k in range(0, 60, 7) for b in R._index(iter([texts.slice(k, 7)])) for r in b.to_pylist()]
    out.sort(key=lambda r: tuple(r.values()))
    schema = pa.schema([(c, pa.int64()) for c in ("at", "ctx", "doc", "tie", "meta")])
    found = [r for b in R._merge_scan(iter([pa.RecordBatch.from_pylist(out[k : k + 64], schema) for k in range(0, len(out), 64)])) for r in b.to_pylist()]
    gone = {i: set() for i, _ in rows}
    for r in found:
        if not r["border"]:
            gone[r["doc"]] |= set(range(r["a"], r["b"]))
    want = brute(rows)
    for i, t in rows:
        assert len(gone[i]) <= want[i, t][1]
    assert sum(map(len, gone.values())) > 0.5 * sum(x[1] for x in want.values())


def test_arrays_are_in_suffix_order(words):
    import pyarrow as pa

    part, _, _ = next(R._segments(pa.array([words(300, 1), words(300, 2)])))
    suffix, anchor, context, text, at, more = R.entries(part)
    index = R.Family()
    index.add(suffix, anchor, context, text, text * 0, at, more)
    raw = [bytes(x).ljust(R.SUFFIX, b"\0") for x in index.levels[0][0]]
    assert raw == sorted(raw) and len(set(raw)) == len(raw)
    data = part.data.tobytes()
    for k in range(len(text)):
        after, before = raw[k][-2], raw[k][-1] - 1
        doc, start = index.levels[0][3][k], index.levels[0][5][k]
        place = part.bounds[doc] + start + before
        assert data[place : place + after] == raw[k][:after] and data[place - before : place][::-1] == raw[k][100 : 100 + before]


def test_long_texts_in_segments(spark, monkeypatch, words):
    from lodestrand.llm import texts

    for module in (R, texts):
        monkeypatch.setattr(module, "SLICE_BYTES", 5000)
    long = words(4000, 1)
    rows = [(1, long), (2, words(30, 2) + long[7000:15000] + words(30, 3))]
    index = R.Family()
    for i, t in rows:
        import pyarrow as pa

        for part, row, offset in R._segments(pa.array([t])):
            suffix, anchor, context, text, at, more = R.entries(part)
            index.add(suffix, anchor, context, text * 0 + i, text * 0, at + offset, more)
    doc, _, start, end = R._merged(*(__import__("numpy").concatenate(x) for x in zip(*index.marks)))
    assert 2 in doc.tolist() and max((end - start)[doc == 2]) > 7800


def test_odd_rows(spark, odd, odd_rows, empty):
    want = brute(odd_rows, hashes(spark, odd_rows).__getitem__)
    assert by_row(odd, odd_rows) == sorted(repr((i, *want[i, t or ""])) for i, t in odd_rows)
    assert R.remaining(empty).collect() == [] == R.cut(empty).collect()


def test_cut_keeps_rows_columns_and_characters(odd, odd_rows):
    got = R.cut(odd)
    assert got.columns == odd.columns and got.count() == len(odd_rows)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert by_id[1] == [None] and by_id[2] == [""] and by_id[6] == [""] and by_id[8][0].startswith("Ünïcödé")


def test_levels_fall_geometrically():
    import numpy as np

    family, rng = R.Family(), np.random.default_rng(1)
    for k in range(40):
        context = rng.integers(1 << 62, size=500).astype(np.uint64)
        suffix = np.array([b"%020d" % c for c in context], dtype=f"S{R.SUFFIX}")
        family.add(suffix, context, context, np.full(500, k), np.zeros(500, np.int64), np.arange(500), np.zeros(500, np.int64))
        sizes = [len(x[0]) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert len(family) == 20_000 and len(family.levels) < 7
