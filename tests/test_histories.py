"""Histories against plain loops: dense ones, one group with most of the rows, ties and nulls."""

import random

import pytest

from lodestrand.operators.histories import selection_history, splash_shows

TTL = 3_600_000


def shown(visits):
    last, out = {}, {}
    for user, i, t in sorted(visits, key=lambda v: (v[2], v[1])):
        out[i] = user not in last or t - last[user] > TTL
        if out[i]:
            last[user] = t
    return out


def selected(actions):
    state, out = {}, {}
    for panel, at, index, n_visible in sorted(actions, key=lambda a: a[1]):
        s = state.setdefault(panel, set())
        visible = set(range(n_visible))
        if index is not None:
            s ^= {index}
        elif visible and visible <= s:
            s -= visible
        else:
            s |= visible
        out[panel, at] = (len(s), bool(visible) and visible <= s)
    return out


def test_splash_shows(spark):
    rng = random.Random(1)
    visits = [(rng.choice((1, 2, None)), k, rng.randrange(40 * TTL)) for k in range(300)]
    visits += [(3, 1000 + k, k * TTL // 7) for k in range(2000)]  # no visit is long after the one before it
    visits += [(4, 5000 + k, k // 3 * TTL // 2) for k in range(60)]  # ties, and times exactly one ttl apart
    df = spark.createDataFrame(visits, "user bigint, id bigint, millis bigint").repartition(5)
    assert {r.id: r.shown for r in splash_shows(df).collect()} == shown(visits)
    assert splash_shows(df.where("false")).collect() == []


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_selection_history(spark, share):
    rng = random.Random(2)
    index = lambda: None if rng.random() < share else rng.randrange(5)
    actions = [(1, k, index(), 3) for k in range(1500)]  # most rows are of one panel
    actions += [(p, 10_000 + k, index(), p % 4) for p in (2, 3, 4, 5, None) for k in range(60) if p is not None]
    actions += [(6, 20_000 + k, 0, 1) for k in range(40)] + [(7, 30_000 + k, None, 2) for k in range(9)]
    rows = [(p, at, i, None if i is None else i < n, n) for p, at, i, n in actions]
    df = spark.createDataFrame(rows, "panel bigint, at bigint, index int, visible boolean, n_visible int").repartition(3)
    got = {(r.panel, r.at): (r.n_selected, r.every) for r in selection_history(df, "at").collect()}
    assert got == selected(actions)
