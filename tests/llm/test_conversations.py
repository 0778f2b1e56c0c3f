"""The repair against a search over all edits, and against a plain loop for long conversations."""

import hashlib
import itertools
import random
import re

import pytest

from lodestrand.llm import conversations
from lodestrand.llm.conversations import repair, repaired_turns

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def replay(rows, audit):
    """The repaired turns, or None where the edits don't give the pattern."""
    lines, left = [], list(rows)
    for op in audit:
        want = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
        if op == "I":
            lines.append((want, ""))
            continue
        _, role, text = left.pop(0)
        if op != "D":
            lines.append((role if op == "K" else want, text))
    fits = re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines))
    return lines if fits and not left else None


def price(found, audit):
    ops = [op for op in audit if op != "I"]
    if any(f in ("blank", "duplicate") and op != "D" for f, op in zip(found, ops)):
        return None
    return sum({"K": 0, "R": 1, "D": 2}[op] + 5 * (f == "truncated" and op != "D") for f, op in zip(found, ops)) + 5 * audit.count("I")


def searched(rows):
    """The cheapest, then least, of all audits with up to two insertions at each gap."""
    found, best = faults(rows), None
    for ops in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            audit = "".join(g + o for g, o in zip(gaps, (*ops, "")))
            cost = price(found, audit)
            if cost is not None and (best is None or (cost, audit) < best) and replay(rows, audit) is not None:
                best = (cost, audit)
    return best


def looped(rows):
    """The same state by state."""
    best = {"": (0, "")}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def put(to, key, value):
        if key is not None and (key not in to or value < to[key]):
            to[key] = value

    def insert(states):
        for _ in range(2):
            for s, (c, a) in list(states.items()):
                put(states, step.get((s, "a" if s == "u" else "u")), (c + 5, a + "I"))

    for (_, role, _), fault in zip(rows, faults(rows)):
        insert(best)
        after, pay = {}, 5 * (fault == "truncated")
        for s, (c, a) in best.items():
            put(after, s, (c + 2, a + "D"))
            if fault not in ("blank", "duplicate"):
                put(after, step.get((s, role[:1])), (c + pay, a + "K"))
                put(after, step.get((s, "a" if s == "u" else "u")), (c + pay + 1, a + "R"))
        best = after
    insert(best)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows, solve):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    turns, found = [t for t, _, _ in rows if t is not None], faults(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = solve(rows)
    text = "\n".join(f"{r}:{t}" for r, t in replay(rows, audit))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def made(rng, n):
    roles, texts = ("user", "assistant", "system", "agent", "tool", ""), ("Yes.", "No!", "so what", " \n", "Why? ", "a b", "one.", "é😀.")
    return [(None if rng.random() < 0.1 else rng.randrange(12), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def frame(spark, conversations_):
    rows = [(c, *r) for c, turns in conversations_.items() for r in turns]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "conv_id bigint, turn bigint, role string, text string").repartition(5)


def results(got):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}


def test_query(same_rows):
    same_rows("op13_turn_fold")


def test_search_and_loop_agree():
    rng = random.Random(3)
    for _ in range(150):
        rows = made(rng, rng.randrange(4))
        assert searched(rows) == looped(rows) or not rows


def test_short(spark):
    rng = random.Random(4)
    given = {k: made(rng, rng.randint(1, 3)) for k in range(60)} | {k: made(rng, rng.randint(4, 12)) for k in range(60, 160)} | {None: made(rng, 5)}
    want = {k: expected(rows, searched if len(rows) < 4 else looped) for k, rows in given.items()}
    assert results(repair(frame(spark, given))) == want


@pytest.mark.parametrize("chunk, composed", [(3, 2), (8, 32)])
def test_many_chunks(spark, monkeypatch, chunk, composed):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    monkeypatch.setattr(conversations, "COMPOSED", composed)
    rng = random.Random(5)
    given = {k: made(rng, n) for k, n in enumerate((1, 3, 4, 9, 30, 70))}
    given[9] = [(i, rng.choice(("user", "assistant", "system")), rng.choice(("Same.", f"text {i}."))) for i in range(90)]
    given[10] = [(i, "user", " ") for i in range(20)]
    got = frame(spark, given)
    assert results(repair(got)) == {k: expected(rows, looped) for k, rows in given.items()}
    lines = sorted((r for r in repaired_turns(got).collect() if r.conv_id == 9), key=lambda r: (r.part, r.place))
    rows = sorted(given[9])
    assert [(r.role, r.text) for r in lines] == replay(rows, looped(rows)[1])


def test_one_conversation_holds_most(spark):
    turn = lambda i: (i, ("user", "assistant")[i % 2], "Once more." if i % 3 else f"Number {i}.")
    given = {1: [turn(i) for i in range(3000)], **{k: [turn(i) for i in range(4)] for k in range(2, 60)}}
    assert results(repair(frame(spark, given))) == {k: expected(rows, looped) for k, rows in given.items()}


def test_odd_rows(spark, odd, empty):
    nothing = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair(nothing).collect() == []
    rows = spark.createDataFrame(
        [(1, 0, None, None, True, "x"), (1, None, "user", "z" * 3_000_000 + ".", True, "x"), (2, 5, "user", "Gone.", False, "x"), (3, 1, "", "", True, "x")],
        "conv_id bigint, turn bigint, role string, text string, present boolean, part string",
    )
    want = {1: expected([(0, " ", " "), (None, "user", "z" * 3_000_000 + ".")], looped), 2: expected([], looped), 3: expected([(1, "", "")], looped)}
    assert results(repair(rows)) == want
