import corpus_pipeline
from lodestrand.llm import decontamination, near_duplicates, toxicity
from lodestrand.llm.store import materialise


def test_stages_on_their_own_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-dedup", "suffix-dedup", "decontamination", "packing"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], small), "test"))
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.7").collect()} != ids[0]
    assert ids[2] == {r.class_id for r in near_duplicates.classes(tables[1]).collect()} != ids[1]
    assert ids[3] == ids[2] and tables[3].where("n_chars <> length(text)").count() == 0
    leaks = decontamination.leaks(tables[3], spark.read.parquet(f"{small}/benchmark.parquet"))
    assert ids[4] == ids[3] - {r.doc_id for r in leaks.collect()} != ids[3]
    assert ids[5] == ids[4]


def test_odd_rows_pass_through(spark, small, odd, empty):
    for docs in (odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "bigint(length(text)) AS n_chars", "size", "ranges"), empty.select("doc_id", "text")):
        table = materialise(docs, "odd")
        for _, stage in corpus_pipeline.STAGES:
            table = materialise(stage(spark, table, small), "odd")
        assert (table.count() > 0) == (docs.count() > 0)
