import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrand.llm import token_files as F
from lodestrand.llm.queries import QUERIES
from lodestrand.llm.tokens import encoder


@lru_cache
def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def plain_ids(name, texts):
    t = tokenizer(name)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


PIECES = st.sampled_from(["a", "B", "é", " ", "  ", "\n", "\t", " \n", ".", ",", "!", "123", "'s", "don't", "\xa0", "İ", "ß", "日本", "<|endoftext|>", "\x1c", "\x85", "é", " ́", "😀", "word", "The "])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_whole_texts_ids(name):
    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=8))
    def check(texts):
        ids, n = encoder(name).encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == plain_ids(name, texts) if texts else not len(ids)

    check()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_code_round_trip(ranks):
    ranks = np.array(ranks, dtype=np.uint32)
    control, data = F.encode_ranks(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert np.array_equal(F.decode_ranks(control, data, len(ranks)), ranks)


def test_query_is_the_tokenizer(spark, small, small_docs):
    start, want = 0, []
    for (i, _), ids in zip(small_docs, plain_ids("byte_bpe_50k.json", [t for _, t in small_docs])):
        ids = np.array([*ids, 0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op8_token_files"](spark, small).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_odd_rows(spark, odd, odd_rows, empty, tmp_path):
    F.write(odd, str(tmp_path / "odd"))
    got = F.read(spark, str(tmp_path / "odd")).orderBy("start").collect()
    want = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*x, 0] for x in plain_ids("byte_bpe_50k.json", [t for _, t in want])]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    F.write(empty, str(tmp_path / "none"))
    assert F.read(spark, str(tmp_path / "none")).collect() == []


def test_many_rows_of_one_id_or_none(spark, tmp_path):
    rows = [(None if k % 2 else 7, f"text number {k % 300}") for k in range(6000)]
    F.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), str(tmp_path / "many"))
    got = F.read(spark, str(tmp_path / "many")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 3000 + [7] * 3000 and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    sizes = {r.part: r.n for r in spark.read.parquet(str(tmp_path / "many" / "blocks")).selectExpr("part", "size(doc_ids) n").groupBy("part").sum("n").toDF("part", "n").collect()}
    assert max(sizes.values()) < 3000


def test_ids_are_counted_where_they_are_made(spark, words, tmp_path):
    """The counts come from the tasks that tokenize, not from another pass over the ids; both widths of ranks come back."""
    docs = spark.createDataFrame([(k, words(50, k)) for k in range(40)], "doc_id bigint, text string").repartition(3)
    blocks = F._tokenized(docs, "byte_bpe_50k.json", 0, "bigint").cache()
    want = Counter(i for r in blocks.where("part IS NOT NULL").collect() for i in np.frombuffer(r.ids, dtype="<u4").tolist())
    counted = F._frequencies(blocks.drop("ids"))
    assert {r.id: r.n for r in counted.collect()} == dict(want) and want[0] == 40
    for ranks in ([0, 255, 256, 65535], [1, 65536, 3, 1 << 24, 255], []):
        assert F.decode_ranks(*F.encode_ranks(np.array(ranks, dtype=np.uint32)), len(ranks)).tolist() == ranks
