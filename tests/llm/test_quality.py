import collections
import re

from pyspark.sql import functions as F

from lodestrand.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {t for t, n in collections.Counter(tri).items() if n > 1}
    covered = {k + j for k, t in enumerate(tri) if t in twice for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_query_has_its_sql(same_rows):
    same_rows("op2_quality_ledger")
    same_rows("quality_ablations")


def test_odd_rows_are_brute_force(odd, odd_rows, empty):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(odd).collect()]
    assert sorted(got, key=key) == sorted(((i, *brute(t)) for i, t in odd_rows), key=key)
    assert quality.ledger(empty).collect() == []


def test_policies_and_ablations(odd):
    book = quality.ledger(odd).cache()
    rows = book.collect()
    for r in quality.ablations(book).collect():
        policy = next(p for p in quality.POLICIES if (p.name, p.version) == (r.policy, r.version))
        bit, mask = quality.BIT[r.rule], policy.mask
        assert r.n_failed == sum(bool(x.failed & bit) for x in rows)
        assert r.n_failed_alone == sum(x.failed & mask == bit for x in rows)
        assert r.n_kept == sum(x.failed & mask == 0 for x in rows) == book.where(quality.passes(policy)).count()
    assert quality.histogram(book).agg(F.sum("n_docs")).first()[0] == len(rows)
