import random
import re

import pyarrow as pa

from lodestrand.llm import licences as L
from lodestrand.llm.queries import QUERIES
from lodestrand.llm.texts import slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    places = [(k, label) for p, label in L.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_query_is_brute_force(spark, small, small_docs):
    got = {r.doc_id: r for r in QUERIES["op10_licence_automaton"](spark, small).collect()}
    assert {i: base(r) for i, r in got.items()} == {i: brute(t) for i, t in small_docs}
    text = dict(small_docs)
    for i, r in got.items():
        assert ("mit" in r.labels.split(",")) == ("Released under the MIT License" in text[i])
        assert ("apache-2.0" in r.labels.split(",")) == ("Apache License, Version 2.0" in text[i])


def test_matching_statistics_are_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        templates = [[rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for _ in range(4)]
        phrases = [(" ".join(map(str, t)), "x") for t in templates[:2]]
        scanner = L.Scanner(tuple(phrases), tuple((str(k), " ".join(map(str, t))) for k, t in enumerate(templates[2:])))
        text = [rng.randint(0, 3) for _ in range(40)]
        got = scanner.scan(next(slices(pa.array([" ".join(map(str, text))]))))[0]
        want = sorted((k, s) for k, t in enumerate(templates[:2]) for s in range(len(text)) if text[s : s + len(t)] == t and len(t) > 1)
        assert sorted(p for p in got["places"] if len(templates[p[0]]) > 1) == want


def test_spans_with_gaps_and_edits(spark):
    mit = next(t for x, t in L.TEMPLATES if t.startswith("permission"))
    words = mit.split()
    edited = " ".join(words[:25] + ["truly", "and"] + words[25:45] + words[48:])
    docs = [(1, "Some prose. " + mit.upper() + "! More."), (2, edited), (3, " ".join(words[:10])), (4, " ".join(reversed(words)))]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert rows[1].labels == "mit" and rows[1].score == 1.0 and (rows[1].spans[0].first_word, rows[1].spans[0].last_word) == (2, 1 + len(words))
    assert rows[2].labels == "mit" and 0.8 <= rows[2].score < 1
    assert rows[3].labels == "" and 0 < rows[3].score < 0.8 and rows[4].labels == ""


def brute_chain(words, template):
    """The largest cover of any chain, by trying all of them."""
    n = len(template)
    runs = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i >= min(L.LONG, n)
            and any(template[k : k + j - i] == words[i:j] for k in range(n))}
    # Those that can't be longer to the right or begin earlier with the same end.
    most = [(i, j) for i, j in runs if (i, j + 1) not in runs and (i - 1, j) not in runs]
    found = sorted((j, i, k + j - i) for i, j in most for k in range(n) if template[k : k + j - i] == words[i:j])
    best = 0

    def extend(last, cover):
        nonlocal best
        best = max(best, cover)
        for j, i, place in found:
            if j > last[0] and i - last[0] <= L.GAP and place > last[2]:
                extend((j, i, place), cover + min(j - i, place - last[2], j - last[0]))

    for one in found:
        extend(one, one[0] - one[1])
    return best / n


def test_chains_are_brute_force(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(L, "LONG", 3)
    monkeypatch.setattr(L, "GAP", 3)
    several = 0
    for _ in range(150):
        template = [rng.choice("abc") for _ in range(rng.randint(4, 12))]
        scanner = L.Scanner((("z z", "z"),), (("t", " ".join(template)),))
        words = []
        while len(words) < 24:
            k = rng.randrange(len(template))
            words += rng.choice([template[k : k + 5], ["x"] * rng.randint(1, 5), [rng.choice("abc")]])
        got = scanner.scan(next(slices(pa.array([" ".join(words)]))))[0]["spans"]
        want = brute_chain(words, template)
        assert abs(max((x[3] for x in got), default=0) - want) < 1e-9
        several += 0.5 < want < 1
    assert several > 20


def test_whole_texts_and_stray_matches(spark):
    mit, bsd2 = max((t for x, t in L.TEMPLATES if x == "mit"), key=len), next(t for x, t in L.TEMPLATES if x == "bsd-2-clause")
    third = next(t for x, t in L.TEMPLATES if x == "bsd-3-clause")
    opening = next(t for x, t in L.TEMPLATES if x == "mit" and t.startswith("permission") and t != mit)
    w = opening.split()
    half = bsd2.index("this software is provided by")
    docs = [(1, mit), (2, " ".join(w[:30] + w[:4] + w[30:])), (3, bsd2), (4, bsd2[:half] + "3 " + third + " " + bsd2[half:]), (5, mit[300:])]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert rows[1].labels == "mit,warranty" and rows[1].score == 1.0
    assert rows[2].labels == "mit" and rows[2].score == 1.0 and (rows[2].spans[0].first_word, rows[2].spans[0].last_word) == (0, len(w) + 3)
    assert rows[3].labels == "bsd,bsd-2-clause" and "bsd-3-clause" in rows[4].labels and "bsd-2-clause" not in rows[4].labels
    assert "mit" not in rows[5].labels


def test_odd_rows(spark, odd, odd_rows, empty):
    got = [(r.doc_id, *base(r)) for r in L.scan(odd).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *brute(t))) for i, t in odd_rows)
    assert L.scan(empty).collect() == []
