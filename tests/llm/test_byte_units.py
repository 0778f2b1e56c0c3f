"""Pieces of byte-level vocabularies: parts of texts that are cut at bytes, against the library's ids of the whole."""

import random

import pytest
from test_added_tokens import FILES, library_ids
from test_word_units import PARTS, ids

from lodestrand.llm import tokens
from lodestrand.llm.tokens import PieceEncoder

NAME = "byte_bpe_50k.json"


def test_any_character_beside_any_kind():
    forms = ("A.{0}.Z", "9{0}'S {0}H{0}", "{0}", " {0}  {0} x\n{0}\n")
    texts = [x.format(chr(c)) for c in [*range(0x3100), 0xFB1D, 0xFEFF, 0x1F600] for x in forms]
    assert ids(PieceEncoder(NAME, added=True), texts) == library_ids(NAME, texts)


def test_mixtures(monkeypatch):
    """With a cache that starts afresh again and again, too."""
    rng = random.Random(5)
    parts = [*PARTS, *"   \n\r\t　", "don't", " \n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)]
    tok = PieceEncoder(NAME, added=True)
    want = library_ids(NAME, texts)
    assert ids(tok, texts) == want
    monkeypatch.setattr(tokens, "CACHE_UNITS", 100)
    assert [x for k in range(0, len(texts), 1000) for x in ids(tok, texts[k : k + 1000])] == want


def test_words_are_encoded_once_whatever_marks_follow(monkeypatch):
    """Texts of the same words with other marks and line ends have no new piece for the model but the marks."""
    tok = PieceEncoder(NAME, added=True)
    names = ["".join(random.Random(k).choices("abcdefgéö", k=9)) for k in range(500)]
    ids(tok, [" " + " ".join(names) + "\n" + "\n".join(names)])
    sent = []
    raw = PieceEncoder._raw
    monkeypatch.setattr(PieceEncoder, "_raw", lambda self, texts, *more: sent.extend(texts) or raw(self, texts, *more))
    text = "".join(f' {a}, {b}.\n{c}; 12\n\n' for a, b, c in zip(names, names[1:], names[2:]))
    assert ids(tok, [text]) == library_ids(NAME, [text])
    assert {p for t in sent for p in t.split("\n")} <= {"", ",", ".", ";", " 12"}


@pytest.mark.parametrize("name", FILES)
def test_long_pieces_dont_pile_up(name, monkeypatch):
    """Texts without spaces are pieces of their own; however many there are, the cache holds no more ids than its limit and a call's."""
    monkeypatch.setattr(tokens, "CACHE_IDS", 5000, raising=False)
    tok, rng = PieceEncoder(name, added=True), random.Random(6)
    for _ in range(30):
        texts = ["".join(rng.choices("日本語文字列処理。", k=100)) for _ in range(20)]
        assert ids(tok, texts) == library_ids(name, texts)
        assert tok.used <= 5000 + 20 * 300
