import itertools
import random
import zlib

import numpy as np
from test_token_files import plain_ids

from lodestrand.llm import packing as P
from lodestrand.llm.queries import QUERIES


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                left = list(rooms)
                left.remove(room)
                place(k + 1, [*left, room - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def counted(lengths):
    return {n: lengths.count(n) for n in set(lengths)}


def spent(plan):
    total = {}
    for pattern, n in plan:
        for length, each in pattern:
            total[length] = total.get(length, 0) + each * n
    return total


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    fixed = 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 31])
        lengths = [rng.randint(max(1, capacity // 6), capacity) for _ in range(rng.randint(0, 8))]
        plan, left = P.reduce_lengths(counted(lengths), capacity)
        rest = list(itertools.chain.from_iterable([n] * c for n, c in left.items()))
        fixed += sum(n for _, n in plan)
        assert sum(n for _, n in plan) + fewest(rest, capacity) == fewest(lengths, capacity)
        assert counted(lengths) == {n: spent(plan).get(n, 0) + left.get(n, 0) for n in set(lengths)}
    assert fixed > 100


def test_plans_hold_all_pieces_and_fit():
    rng = random.Random(5)
    for _ in range(100):
        counts = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(rng.randint(0, 60))}
        plan = P.make_plan(counts)
        assert spent(plan) == counts and all(sum(a * b for a, b in p) <= 2048 for p, _ in plan)
        keys, places = P.lay_out(plan)
        slots = set()
        for length, c in counts.items():
            key = (length << 44) + np.arange(c)
            at = np.searchsorted(keys, key, side="right") - 1
            nth = key - keys[at]
            sequence = places[at, 0] + nth // places[at, 1]
            offset = places[at, 2] + nth % places[at, 1] * length
            slots |= {(s, o, length) for s, o in zip(sequence.tolist(), offset.tolist())}
        assert len(slots) == sum(counts.values())
        check_sequences(slots, 2048)


def check_sequences(slots, capacity):
    by = {}
    for s, o, n in slots:
        by.setdefault(s, []).append((o, n))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= capacity
    return len(by)


def test_query(spark, small, small_docs):
    want = []
    for (i, _), ids in zip(small_docs, plain_ids("word_bpe_49k.json", [t for _, t in small_docs])):
        ids = np.array([*ids, 0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = QUERIES["op9_best_fit"](spark, small).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = check_sequences({(r.sequence_id, r.offset, r.length) for r in got}, 2048)
    assert n <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_odd_rows(odd, odd_rows, empty):
    rows = P.pack(odd, capacity=100).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd_rows)
    slots = [(r.sequence_id, r.offset, r.length) for r in rows]
    assert len(set(slots)) == len(slots)
    check_sequences(set(slots), 100)
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert P.pack(empty).collect() == []
