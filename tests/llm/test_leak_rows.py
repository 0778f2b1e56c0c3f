"""Leaks of shared ids, families and very short items; covered words and slots against a plain count."""

import re
from collections import Counter

import pytest

from lodestrand.llm import decontamination as D

FAMILY = "Read the following short story with care and then answer the one question that stands below it."


def tables(spark, docs, items):
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, text string")
    return table(docs, "doc_id"), table(items, "item_id")


def rows(spark, docs, items):
    return sorted(((r.doc_id, r.item_id, r.covered, r.n_slots) for r in D.leaks(*tables(spark, docs, items)).collect()), key=repr)


def test_rows_of_one_id_are_judged_alone(spark, words):
    item = words(24, 1)
    half = item.split()
    docs = [(1, item), (1, words(60, 2)), (2, " ".join(half[:8])), (2, " ".join(half[12:20])), (None, item), (None, words(50, 3)), (None, None), (3, item), (3, item)]
    assert rows(spark, docs, [(9, item)]) == sorted(((i, 9, 24, 0) for i in (1, None, 3)), key=repr)
    kept = D.keep_clean(*tables(spark, docs, [(9, item)])).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(d for d in docs if d[1] != item)


def test_a_family_gives_one_row_for_each_document(spark, words):
    items = [(k, f"{FAMILY} {words(20, 100 + k)}") for k in range(200)]
    docs = [(k, f"{words(30, 500 + k)}. {FAMILY} {words(30, 900 + k)}") for k in range(200)] + [(1000, items[77][1]), (1001, words(20, 100 + 150)), (1002, words(90, 5))]
    got = rows(spark, docs, items)
    n = len(FAMILY.split())
    assert [r[:3] for r in got if r[0] < 1000] == sorted(((k, 0, n) for k in range(200)), key=repr)
    # Whoever has more than the common text leads to its item, with all of it; the family's first stays too.
    assert [r[:3] for r in got if r[0] >= 1000] == [(1000, 0, n), (1000, 77, n + 20), (1001, 150, 20)]
    members = D.families(tables(spark, docs, items)[1]).collect()
    assert {(r.family, r.item_id) for r in members} == {(0, k) for k in range(200)}


def test_two_families_together_make_a_leak(spark, words):
    """Items of two families of 30, of which ten have both common texts; either one alone is too little of an item."""
    one, two = words(9, 71), words(9, 72)
    items = [(k, f"{one if k < 30 else words(9, 2000 + k)} {words(40, 3000 + k)} {two if k >= 20 else words(9, 4000 + k)}") for k in range(50)]
    docs = [(1, f"{words(30, 81)} {one} {words(30, 82)} {two} {words(30, 83)}"), (2, f"{words(30, 84)} {one} {words(30, 85)}")]
    t = tables(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in D.leaks(*t, every=True).collect()} == {(1, k) for k in range(20, 30)}
    assert {(r.doc_id, r.item_id) for r in D.leaks(*t).collect()} == {(1, 20)}


def test_no_document_with_two_families_is_kept(spark, words):
    """The first item of either family has only one of the common texts, which is too little of it; 29 others have both."""
    one, two = words(9, 71), words(9, 72)
    items = [(k, f"{one if k != 0 else words(9, 2000 + k)} {words(40, 3000 + k)} {two if k != 1 else words(9, 4000 + k)}") for k in range(31)]
    docs = [(1, f"{words(30, 81)} {one} {words(30, 82)} {two} {words(30, 83)}"), (2, f"{words(30, 84)} {one} {words(30, 85)}")]
    assert [r.doc_id for r in D.keep_clean(*tables(spark, docs, items)).collect()] == [2]


def test_every_item_of_a_family(spark, words):
    items = [(k, f"{FAMILY} {words(20, 100 + k)}") for k in range(40)]
    docs = [(k, f"{words(30, 500 + k)}. {FAMILY} {words(30, 900 + k)}") for k in range(10)] + [(100, words(90, 5))]
    got = D.leaks(*tables(spark, docs, items), every=True).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, j) for k in range(10) for j in range(40)} and len(got) == 400


def test_very_short_items_are_whole_sentences(spark):
    items = [(1, "in the"), (2, "Four more words here")]
    docs = [(1, "A cat in the house. It was in the garden."), (2, "What now?\nIn the\nNothing."), (3, "x four more words here y"), (4, "So. Four more words here! y")]
    assert {r[:2] for r in rows(spark, docs, items)} == {(2, 1), (4, 2)}


def plain(doc, item):
    """covered and n_slots where only numbers are slots, by all pairs of windows: of plain words, and of words with placeholders."""
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    d, i = split(doc), split(item)
    shape = lambda x: ["#" if w.isdigit() else w for w in x]
    at = lambda x: [(k, tuple(x[k : k + D.WINDOW])) for k in range(len(x) - D.WINDOW + 1)]
    covered = {k + j for k, w in at(i) for _, v in at(d) if w == v for j in range(D.WINDOW)}
    slots = set()
    shifts = {}
    for k, w in at(shape(i)):
        for m, v in at(shape(d)):
            if w == v and w.count("#") <= D.WINDOW - D.LITERALS:
                shifts.setdefault(m - k, []).append((k, m))
    for hits in shifts.values():
        runs = [[hits[0]]]
        for a, b in zip(hits, hits[1:]):
            runs.append([b]) if b[0] > a[0] + D.WINDOW else runs[-1].append(b)
        for run in runs:
            pairs = {(i[k + j], d[m + j]) for k, m in run for j in range(D.WINDOW) if i[k + j].isdigit()}
            broken = {x for x, n in Counter(x for x, _ in pairs).items() if n > 1}
            for k, m in run:
                own = {(i[k + j], d[m + j]) for j in range(D.WINDOW) if i[k + j].isdigit()}
                if all(x == y for x, y in own) or not broken & {x for x, _ in own}:
                    covered |= {k + j for j in range(D.WINDOW)}
                    slots |= own
    return len(covered), len(slots)


def test_kept_documents_against_all_pairs(spark, words):
    """Common texts that 10 to 40 items hold, two in each item; documents of one to three of them. Rows and kept ones are those of a plain count."""
    common = [words(9, 700 + k) for k in range(6)]
    items = [(k, f"{common[k % 6]} {words(30 + k % 9 * 4, 7000 + k)} {common[(k % 6 + 1 + k // 6 % 5) % 6]}") for k in range(120)]
    docs = [(k, " ".join([words(20, 8000 + k), *(f"{common[(k * j + j) % 6]} {words(12, 9000 + 9 * k + j)}" for j in range(1, 2 + k % 3))])) for k in range(40)]
    held = Counter(c for _, t in items for c in common if c in t)
    assert max(held.values()) > 2 * D.FAMILY
    enough = lambda n, t: n >= D.RUN or n >= D.SHARE * len(re.findall(r"[^\W_]+", t))
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    at = lambda t: [tuple(split(t)[k : k + D.WINDOW]) for k in range(len(split(t)) - D.WINDOW + 1)]
    want = set()
    for d, text in docs:
        there = set(at(text))
        want |= {(d, i) for i, t in items if enough(len({k + j for k, w in enumerate(at(t)) if w in there for j in range(D.WINDOW)}), t)}
    t = tables(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in D.leaks(*t, every=True).collect()} == want
    dirty = {d for d, _ in want}
    assert 0 < len(dirty) < len(docs)
    assert {r.doc_id for r in D.keep_clean(*t).collect()} == {d for d, _ in docs} - dirty


@pytest.mark.parametrize("change", [
    lambda t: t, lambda t: t.replace("7", "9"), lambda t: t.replace("7", "9", 1), lambda t: t.replace("30", "7").replace("5", "6"),
    lambda t: t[: len(t) // 2] + " zzz " + t[len(t) // 2 :], lambda t: "zzz " + t.replace("12", "13") + " " + t.replace("5", "8"),
])
def test_covered_and_slots(spark, change):
    item = "take 7 small stones and put 30 of them under the old tree then bring 7 more and count 12 before you give 5 stones to each of them"
    doc = change(item)
    covered, n_slots = plain(doc, item)
    assert rows(spark, [(1, doc)], [(2, item)]) == [(1, 2, covered, n_slots)]
