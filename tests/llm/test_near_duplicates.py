import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import near_duplicates as N
from lodestrand.llm.queries import QUERIES
from lodestrand.llm.texts import slices


def bag(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)
    n = min(5, len(words))
    return collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else collections.Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    ids = [i for i, _ in rows]
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b] and None not in (ids[a], ids[b]) and (ids[a] == ids[b] or similarity(bags[a], bags[b]) >= 0.8):
                x, y = find(a), find(b)
                parent[x] = y
    smallest = {}
    for k, i in enumerate(ids):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [(i, smallest.get(find(k))) for k, i in enumerate(ids)]


def mutated(text, rate, seed):
    rng = random.Random(seed)
    return " ".join("new" + str(rng.random())[2:8] if rng.random() < rate else w for w in text.split())


def test_query_is_brute_force(spark, small, small_docs):
    got = [(r.doc_id, r.class_id) for r in QUERIES["op5_bag_minhash"](spark, small).collect()]
    assert sorted(got) == sorted(brute(small_docs))


def test_chained_family(spark, words):
    """A large group whose members are like some others only: no link between classes may be lost."""
    rows, base = [], words(150, 11)
    for k in range(150):
        rows.append((k, mutated(base, 0.015 * (k % 5), k)))
    rows += [(1000 + k, words(120, 500 + k)) for k in range(20)]
    got = {(r.doc_id, r.class_id) for r in N.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = set(brute(rows))
    assert len({c for _, c in want}) > 25 and got == want


def test_odd_rows(odd, odd_rows, empty):
    got = [(r.doc_id, r.class_id) for r in N.classes(odd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(odd_rows)))
    assert N.classes(empty).collect() == []
    kept = N.keep_first(odd)
    assert kept.columns == odd.columns and 6 not in {r.doc_id for r in kept.collect()}


def test_shared_ids(spark, words):
    """Rows of one id with different texts: each has its own text's class, and none goes for what another one repeats."""
    x, y, z = words(90, 31), words(90, 32), words(90, 33)
    rows = [(1, x), (2, mutated(x, 0.01, 1)), (2, y), (3, mutated(y, 0.01, 2)), (4, z), (4, z), (4, x), (5, mutated(z, 0.01, 3)), (5, words(90, 34)), (6, y)]
    place = brute([(k, t) for k, (_, t) in enumerate(rows)])
    smallest = {}
    for k, c in place:
        smallest[c] = min(rows[k][0], smallest.get(c, rows[k][0]))
    for schema in ("doc_id bigint, text string", "doc_id int, text string"):
        docs = spark.createDataFrame(rows, schema).repartition(3)
        got = N.classes(docs)
        assert got.schema["class_id"].dataType == docs.schema["doc_id"].dataType
        assert sorted(map(tuple, got.collect())) == sorted((rows[k][0], smallest[c]) for k, c in place)
        kept = sorted(map(tuple, N.keep_first(docs).collect()))
        assert kept == sorted(rows[k] for k, c in place if rows[k][0] == smallest[c]) and (2, y) in kept and (4, x) not in kept


def test_signatures_are_unbiased(words):
    base = words(300, 21)
    texts = [base, mutated(base, 0.02, 1), base + " " + base, " ".join([words(20, 5)] * 12), " ".join([words(20, 5)] * 9)]
    part = next(slices(pa.array(texts)))
    text, keys, weight, _ = N.shingles(part)
    hits = np.zeros((5, 5))
    rounds = 60
    for r in range(rounds):
        found = N.signatures(text, N.mix(keys + np.uint64(r * 7919)), weight, 5)
        hits += (found[:, None, :] == found[None, :, :]).mean(axis=2)
    bags = [bag(t) for t in texts]
    for a in range(5):
        for b in range(5):
            assert abs(hits[a, b] / rounds - similarity(bags[a], bags[b])) < 0.03


@pytest.mark.parametrize("hubs", [1, 3, 2000])
def test_components_with_few_hubs(spark, monkeypatch, hubs):
    """With few hubs most nodes go through the shuffles."""
    monkeypatch.setattr(N, "HUBS", hubs)
    rng = random.Random(hubs)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1060)] + [(k, k + 1) for k in range(2000, 2040)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in parent if root(x) != x}
    found = N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in found} == want


def test_a_group_of_copies_is_no_hot_key(spark, words, monkeypatch):
    monkeypatch.setattr(N, "HUBS", 10)
    rows = [(k, words(40, 1)) for k in range(500)] + [(1000 + k, words(40, 100 + k // 2)) for k in range(60)]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: 0 for k in range(500)} | {1000 + k: 1000 + k // 2 * 2 for k in range(60)}


def test_links_between_strangers(spark, words, monkeypatch):
    """All documents share all buckets, whose leader is like none of the others, which are all linked to each other."""
    sketches = N._sketches
    monkeypatch.setattr(N, "_sketches", lambda docs: sketches(docs).withColumn("bands", F.transform("bands", lambda x, i: i.cast("long"))))
    base = words(100, 77).split()
    rng = random.Random(9)

    def changed(n):
        out = list(base)
        for k in rng.sample(range(5, 95), n):
            out[k] = f"new{rng.randrange(10**9)}"
        return " ".join(out)

    rows = [(0, changed(3))] + [(k, changed(1)) for k in range(1, 40)]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: 0} | {k: 1 for k in range(1, 40)}
