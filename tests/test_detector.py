"""The fitted detector: its weights are those of plain counts, and languages that it never saw a statement of are found."""

from lodestrand.operators.detect import LANGUAGES, weights
from lodestrand.plans.queries import QUERIES, counted_weights
from lodestrand.sources.snippets import STATEMENTS, TRAINING, training


def test_weights_are_counts(spark):
    assert weights(spark) == counted_weights()


def test_recall_of_each_language(spark, small):
    rows = {r.lang: (r.n, r.n_found) for r in QUERIES["detector_recall"](spark, small).collect()}
    assert set(rows) == set(LANGUAGES) and all(n and found >= 0.9 * n for n, found in rows.values())


def test_measured_snippets_are_new(spark, small):
    seen = {line for _, text in training() for line in text.split("\n")}
    codes = [r.code for r in QUERIES["detector_measured"](spark, small).select("code").collect()]
    assert not {*codes} & {text for _, text in training()} and all(len(s) > TRAINING + 3 for s in STATEMENTS.values())
    assert sum(line in seen for c in codes for line in c.split("\n")) < 0.5 * sum(c.count("\n") + 1 for c in codes)


def test_prose_is_unknown(spark, small):
    found = QUERIES["detect_lang"](spark, small)  # the derived corpus: one text in six is plain prose
    plain = [r.lang for r in found.where("doc_id % 6 = 5").collect()]
    assert plain.count("unknown") >= 0.95 * len(plain)
