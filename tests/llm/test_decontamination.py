import re

from lodestrand.llm import decontamination as D
from lodestrand.llm.queries import QUERIES

ITEM = "A train leaves Paris at 9 and drives 120 km to the coast where John Smith waits for 3 hours before it goes back to the old town"


def test_exact_passages_are_found(spark, small, small_docs):
    squeeze = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = {r.item_id: squeeze(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in small_docs for i, x in items.items() if x in squeeze(t)}
    assert want and {(r.doc_id, r.item_id) for r in QUERIES["op3_template_leaks"](spark, small).collect()} == want


def test_reparameterised_questions(spark, words):
    docs = [
        (1, words(50, 1) + ". " + ITEM + ". " + words(50, 2)),
        (2, ITEM.replace("9", "7").replace("120 km", "80 miles").replace("John Smith", "Mary").replace("Paris", "Rome").replace("3", "5")),
        (3, "Now 1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (4, words(100, 3)),
        (5, " ".join(reversed(ITEM.split()))),
    ]
    got = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, ITEM)], "item_id bigint, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == {1, 2}
    assert rows[1].covered >= rows[2].covered >= D.RUN


def test_slots_must_correspond(spark):
    item = "Take 5 of these small round things and add 5 more of them until 5 are left"
    docs = [(1, item.replace("5", "8")), (2, item.replace("5", "8", 1).replace("5", "9", 1))]
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, text string")
    assert [r.doc_id for r in D.leaks(table(docs, "doc_id"), table([(1, item)], "item_id")).collect()] == [1]


def test_odd_rows(spark, odd, empty, words):
    bench = [(1, words(80, 3)), (1, words(80, 3)), (2, None), (3, ""), (None, words(80, 2)), (4, "x"), (5, words(6, 9))]
    items = spark.createDataFrame([(*r, "?", "?") for r in bench], "item_id bigint, text string, hash string, tokens string")
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(odd, items).collect())
    assert got == [(5, 1), (6, 1)]
    assert D.leaks(empty, items).collect() == [] and D.leaks(odd, items.where("false")).collect() == []
    assert D.keep_clean(odd, items).count() == odd.count() - 3 and D.keep_clean(odd, items).columns == odd.columns


def test_short_items(spark, words):
    docs = spark.createDataFrame([(1, words(40, 1) + " " + words(6, 9) + " " + words(40, 2)), (2, words(40, 3))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, words(6, 9)), (2, "two words")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()] == [(1, 1)]
