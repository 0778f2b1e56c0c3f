import zlib

from lodestrand.llm import sharding
from lodestrand.llm.queries import QUERIES


def brute(rows, shards):
    raw = [((t or "").encode(), i) for i, t in rows]
    items = sorted(((i is not None, i or 0, zlib.crc32(b), len(b) + 1) for b, i in raw))
    total, upto, out, slots = sum(x[3] for x in items), 0, [], {}
    for known, i, crc, size in items:
        shard = (2 * upto + size) * shards // (2 * total)
        out.append((i if known else None, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        upto += size
    return out


def test_query(spark, small, small_docs):
    got = QUERIES["op4_byte_shards"](spark, small).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(brute(small_docs, 16))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    loads = [sum(r.size for r in got if r.shard == k) for k in range(16)]
    assert max(loads) - min(loads) <= 2 * max(r.size for r in got)


def test_query_has_its_sql(same_rows):
    same_rows("op4_byte_shards")


def test_odd_rows(odd, odd_rows, empty):
    for shards in (1, 3, 16):
        got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_by_bytes(odd, shards).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(odd_rows, shards)))
    assert sharding.shard_by_bytes(empty).collect() == []


def test_native_plan(spark, small):
    plan = QUERIES["op4_byte_shards"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_write_shards(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_write_shards_keeps_every_row(odd, odd_rows, empty, tmp_path, spark):
    sharding.write_shards(odd.drop("shard", "slot"), str(tmp_path / "odd"), 3)
    got = spark.read.parquet(str(tmp_path / "odd"))
    key = lambda r: repr((r[0], r[1]))
    assert sorted(map(key, got.select("doc_id", "text").collect())) == sorted(map(key, odd_rows))
    for rows in got.select("shard", "slot").groupBy("shard").agg({"slot": "collect_list"}).collect():
        assert sorted(rows[1]) == list(range(len(rows[1])))
    want = {(r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard_by_bytes(odd, 3).collect()}
    assert {(r.doc_id, len((r.text or "").encode()) + 1, r.shard, r.slot) for r in got.collect()} == want
    same = spark.createDataFrame([(1, "x")] * 500 + [(2, "y")], "doc_id bigint, text string").repartition(4)
    sharding.write_shards(same, str(tmp_path / "same"), 4)
    assert spark.read.parquet(str(tmp_path / "same")).count() == 501
