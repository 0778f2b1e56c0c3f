from lodestrand.llm import decontamination as D


def found(spark, docs, items):
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, text string")
    return {(r.doc_id, r.item_id) for r in D.leaks(table(docs, "doc_id"), table(items, "item_id")).collect()}


def test_one_contradiction_doesnt_hide_a_copy(spark, words):
    item = f"take 2 {words(60, 21)} then 2 {words(60, 22)} and 7"
    assert found(spark, [(1, item.replace("then 2", "then 3"))], [(1, item)]) == {(1, 1)}


def test_different_values_may_become_equal(spark):
    item = "Take 3 of these small round things and add 4 more of them until none of them are left"
    assert found(spark, [(1, item.replace("3", "5").replace("4", "5"))], [(1, item)]) == {(1, 1)}


def test_dense_and_short_items(spark, words):
    items = [
        (1, "Compute 12 + 7 * 3 - 5 / 2 for x = 4"), (2, "What is 7 * 8?"),
        (3, "Anna Berta, Carl Dora, Emil Frieda, Gustav Heinz, Ida Jutta, Karl Luise, Max Nora"),
    ]
    docs = [(i, f"{words(40, i)}. {t} {words(40, i + 9)}") for i, t in items] + [(4, "What is 9 * 6? Compute 1 + 2 * 3 - 4 / 5 for x = 6")]
    assert found(spark, docs, items) == {(1, 1), (2, 2), (3, 3)}


def test_copies_in_another_case(spark, words):
    items = [(1, "Which river flows through the city of Bonn?"), (2, "Der Hund von Äpfeln und Öl sieht Katze Maus Übung Baum Haus Garten und Straße")]
    docs = [
        (1, f'{words(30, 1)} and asks "{items[0][1]}" {words(30, 2)}'), (2, items[1][1].lower()),
        (3, items[0][1].upper()), (4, words(30, 3)),
    ]
    assert found(spark, docs, items) == {(1, 1), (2, 2), (3, 1)}
