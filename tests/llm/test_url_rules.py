import itertools
import random
import re
import time

from lodestrand.llm import url_rules
from lodestrand.llm.queries import QUERIES

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


def test_query_is_brute_force(spark, small):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = QUERIES["op1_url_rules"](spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined else "allow"))


def test_mines_planted_rules_and_odd_urls(spark):
    bad = [(i, f"https://w{i % 40}.spam.org/buy/{i}?aff=1") for i in range(200)]
    good = [(1000 + i, f"https://w{i % 40}.news.org/read/{i}?aff=1") for i in range(300)]
    new = [(5000, "https://x.spam.org/buy/9"), (5001, "https://x.news.org/read/9"), (5002, None), (5003, "no scheme"), (5004, "https://EXAMPLE.com/en/1"),
           (5005, "a://b://c/d?e#f"), (5006, ""), (5007, "https://x.com"), (5007, "https://x.com/")]
    pages = spark.createDataFrame([(i, u, "?", "?") for i, u in bad + good + new], "page_id bigint, url string, row string, tokens string")
    labels = [(i, 0, 0, "?") for i, _ in bad] + [(i, 1, 0, "?") for i, _ in good] + [(None, 0, 1, "?"), (77, None, None, "?")]
    got = url_rules.judge(pages, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, bad string")).collect()
    assert len(got) == len(pages.collect())
    verdict = {r.page_id: (r.verdict, r.mined) for r in got}
    assert verdict[5000] == ("block", verdict[5000][1]) and "h:spam" in verdict[5000][1] + " p:buy h:spam"
    assert [verdict[i] for i in (5001, 5002, 5003, 5006)] == [("allow", None)] * 4
    for r in got:
        if r.page_id in (5004, 5005):
            assert (r.host, r.path) == brute(dict(new)[r.page_id])[:2]
    assert sorted(r.rule or "" for r in got if r.page_id == 5007) == ["", "com/"]


def wilson(bad, n):
    p, z = bad / n, 1.96
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def brute_rules(rows, min_rows, min_confidence):
    """All item sets, counted one by one; an item is the smallest of the tokens that stand in the same rows."""
    places = {}
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            places.setdefault(t, set()).add(k)
    items = {}
    for t in sorted(places):
        items.setdefault(frozenset(places[t]), t)
    bad = {k for k, (_, b) in enumerate(rows) if b}
    kept = {}
    for n in range(1, len(items) + 1):
        for combo in itertools.combinations(items.items(), n):
            where = frozenset.intersection(*(x for x, _ in combo))
            if len(where) >= min_rows and wilson(len(where & bad), len(where)) >= min_confidence:
                kept[frozenset(t for _, t in combo)] = len(where & bad) / len(where), len(where)
    return {s: x for s, x in kept.items() if not any(o < s and y[0] >= x[0] for o, y in kept.items())}


def test_rules_are_brute_force(spark):
    rng = random.Random(3)
    larger = 0
    for _ in range(3):
        rows = []
        for k in range(160):
            tokens = {t for t in "abcdefg" if rng.random() < 0.55} | {"all"}
            tokens |= {"b2"} if "b" in tokens else set()
            rows.append((sorted(tokens), rng.random() < (0.97 if {"a", "b", "c"} <= tokens else 0.9 if {"d", "e"} <= tokens else 0.25)))
        got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_rows=8, min_confidence=0.55).collect()
        want = brute_rules(rows, 8, 0.55)
        assert {frozenset(r.tokens): (round(r.confidence, 9), r.n_rows) for r in got} == {s: (round(c, 9), n) for s, (c, n) in want.items()}
        larger += sum(len(s) > 2 for s in want)
    assert larger


def test_four_tokens_and_long_tokens(spark):
    rng = random.Random(4)
    rows = [(sorted(t for t in "abcd" if rng.random() < 0.5) + ["x"], None) for _ in range(600)]
    rows = [(t, len(t) == 5) for t, _ in rows]
    mine = lambda **k: {tuple(r.tokens) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), **k).collect()}
    assert mine() == {tuple("abcd")} and mine(max_tokens=3) == set()
    same = "w" * 64
    urls = [(k, f"https://h.org/{same}{'bad' if k % 2 else 'good'}/{k}") for k in range(120)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(120)], "doc_id bigint, quality int, toxic int")
    got = url_rules.judge(spark.createDataFrame(urls, "page_id bigint, url string"), labels).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got)


def test_tokens_that_come_together_cost_nothing(spark):
    rows = [([f"t{k}" for k in range(40)] + [f"u{i}"], i % 3 == 0) for i in range(60)] + [([f"s{k}" for k in range(40)], True)] * 40
    began = time.time()
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [r.tokens for r in rules] == [["s0"]] and time.time() - began < 60


def test_seeds(spark):
    urls = [(k, f"http://m.adult-{k % 3}.example.net/en/{k}") for k in range(60)] + [(100 + k, f"http://m.fine.example.net/en/{k}") for k in range(60)]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    labels = spark.createDataFrame([(100 + k, 1, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    got = url_rules.judge(pages, labels, seeds=("adult",)).collect()
    assert all((r.verdict == "block") == (r.page_id < 100) for r in got) and {r.mined for r in got} == {"w:adult", None}
    assert {(r.verdict, r.mined) for r in url_rules.judge(pages, labels).collect()} == {("allow", None)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.org/")], "page_id bigint, url string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.verdict for r in url_rules.judge(pages, labels).collect()] == ["allow"]
    assert url_rules.judge(pages.where("false"), labels).collect() == []


def test_smaller_rule_covers_larger(spark):
    rows = [(["a", "b"], True)] * 50 + [(["a", "c"], True)] * 50 + [(["d"], False)] * 50
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert ["a"] in [r.tokens for r in rules] and not [r for r in rules if len(r.tokens) > 1 and "a" in r.tokens]
