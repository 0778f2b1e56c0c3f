"""The alignment against whole texts, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrand.llm import alignment
from lodestrand.llm.alignment import A, B, _numbers, align, packed, pair, unpacked


def tokens(text):
    """(ids and ends of A, ids and ends of B) of a whole text, or None."""
    both = pair(A, B)
    raw = (" " + (text or "")).encode()
    if not text:
        return None
    sides = []
    for ids, table in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes), (both.b.encode(text), both.b_bytes)):
        if b"".join(table[i] for i in ids) != raw:
            return None
        sides.append((ids, np.cumsum([len(table[i]) for i in ids]).tolist()))
    return sides


def linked(sides):
    (a, a_ends), (b, b_ends) = sides
    a_starts, b_starts = [0, *a_ends], [0, *b_ends]
    return [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(a_starts[i], b_starts[j]) < min(a_ends[i], b_ends[j])]


def grouped(sides):
    (a, a_ends), (b, b_ends) = sides
    out, i, j = [], 0, 0
    for end in sorted({*a_ends} & {*b_ends}):
        p, q = a_ends.index(end) + 1, b_ends.index(end) + 1
        out.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
        i, j = p, q
    return out


def expected(rows):
    sides = [tokens(t) for _, t in rows]
    links = [linked(s) if s else [] for s in sides]
    counts = Counter(p for x in links for p in set(x))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), s, x in zip(rows, sides, links):
        groups = grouped(s) if s else []
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if s else ""
        out.append((i, len(s[0][0]) if s else 0, len(s[1][0]) if s else 0, len(groups), len(x), sum(counts[p] == top[p[0]] for p in x), sum(counts[p] for p in x), digest))
    return Counter(out)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "a", " ", "  ", " a", "a ", "a  ", "\n", "\n a", "a \n", "a\n\n b", "a\tb", "x   y", "  x", "x  y", "x　 y", "x\u0085 y", "it's 5 o'clock's", "<|endoftext|> <s> </s>",
    "▁", "a▁ b", "\x00 \x7f \x1c x", "é è", "日本 語。 ", "😀 😀😀", "﻿ a", "a​ b", "<0x41> x", "…” ’", "1234567 89", "\r\n x", "word" * 50, "é é",
]


def check(docs, rows):
    assert Counter(tuple(r[c] for c in COLUMNS) for r in docs.collect()) == expected(rows)


def test_small(spark, small, small_docs):
    rows = [(i, (t or "")[:900]) for i, t in small_docs]  # the plain comparison takes time by the square of a text's length
    check(align(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)), rows)


def test_query(spark, small, small_docs):
    from lodestrand.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_segment_alignment"](spark, small).collect()}
    assert len(got) == len(small_docs)
    for i, text in small_docs:
        sides = tokens(text)
        want = (len(sides[0][0]), len(sides[1][0]), hashlib.sha256(";".join(grouped(sides)).encode()).hexdigest()) if sides else (0, 0, "")
        assert (got[i].n_a, got[i].n_b, got[i].groups_sha256) == want


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "SLICE_BYTES", min(block, 1 << 20))
    for name in ("_COUNTED", "_TOKENIZED", "_PACKED"):
        monkeypatch.setattr(alignment, name, 7)
    rng = random.Random(2)
    letters = [" ", " ", " ", "\n", "\t", " ", " ", "a", "the", "é", "'s", "1", ".", "😀", "▁", "ing"]
    rows = [*enumerate(ODD), *((100 + k, "".join(rng.choices(letters[:14], k=rng.randint(1, 12)))) for k in range(150)), (None, "the the"), (None, None), (5, ""), (5, "the")]
    check(align(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)), rows)


def test_odd_rows(odd, odd_rows, empty):
    assert align(empty).collect() == []
    got = align(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    full = {r.doc_id: r.n_a for r in got}
    assert full[4] == len(pair(A, B).a.encode(" " + odd_rows[5][1], add_special_tokens=False).ids) and full[1] == 0 and full[2] == 0


def test_packed():
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    for numbers in (x, x[:0]):
        back, text = unpacked(packed(numbers, b"text"))
        assert _numbers(back).tolist() == numbers.tolist() and text == b"text"


def test_cuts_only_where_safe():
    both = pair(A, B)
    assert both.safe_cuts and not both._safe({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True}}, ["▁a", "a▁"])
