import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrand.llm import packing, token_files
from lodestrand.llm.tokens import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PIECES = st.sampled_from(["a", " ", "  ", "\n", " \n", ".", ",", "don't", "İ", "́", "日本", "word", "The ", "<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "|>"])


@lru_cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def library_ids(name, texts):
    """Of the tokenizer as it comes."""
    t = library(name)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(name):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=8))
    def check(texts):
        ids, n = encoder(name, added=True).encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library_ids(name, texts)

    check()


ROWS = [(1, "foo <|endoftext|> bar"), (2, "<|endoftext|><|endoftext|>"), (3, None), (4, "plain words"), (5, "x<|startoftext|>")]


def test_token_files(spark, tmp_path):
    token_files.write(spark.createDataFrame(ROWS, "doc_id bigint, text string"), str(tmp_path / "t"))
    got = token_files.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = library_ids(FILES[0], [t for _, t in ROWS])
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*x, 0] for x in want]


def test_packing(spark):
    got = packing.pack(spark.createDataFrame(ROWS, "doc_id bigint, text string")).collect()
    want = [np.array([*x, 0], dtype="<u4") for x in library_ids(FILES[1], [t for _, t in ROWS])]
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got) == [(i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(ROWS, want)]
