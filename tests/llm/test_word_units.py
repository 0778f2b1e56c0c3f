"""Pieces of word vocabularies: parts of texts that are cut at bytes, against the library's ids of the whole."""

import random

import numpy as np
from test_added_tokens import library_ids

from lodestrand.llm import tokens
from lodestrand.llm.texts import U64
from lodestrand.llm.tokens import PieceEncoder

NAME = "word_bpe_49k.json"
PARTS = [*"abHSTLD'\"  \n\t.,!#-012_\x1c\x85\xa0\0", *"éÉ×÷İıǅȺßẞ̸̱́=<—’日ΣςÅ각٣²　​😀", "'s", "'LL", "word", "Straße", "<|endoftext|>"]


def ids(tok, texts):
    found, n = tok.encode(texts)
    return [x.tolist() for x in np.split(found, np.cumsum(n)[:-1])]


def test_any_character_beside_any_kind():
    texts = [x.format(chr(c)) for c in [*range(0x2500), *range(0x3000, 0x3100), 0xFB1D, 0x1F600] for x in ("A.{0}.Z", "9{0}'S {0}H{0}", "{0}")]
    assert ids(PieceEncoder(NAME, added=True), texts) == library_ids(NAME, texts)


def test_mixtures(monkeypatch):
    """With a cache that starts afresh again and again, too."""
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(20_000)]
    tok = PieceEncoder(NAME, added=True)
    want = library_ids(NAME, texts)
    assert ids(tok, texts) == want
    monkeypatch.setattr(tokens, "CACHE_UNITS", 100)
    assert [x for k in range(0, len(texts), 1000) for x in ids(tok, texts[k : k + 1000])] == want


def test_words_are_encoded_once_whatever_surrounds_them(monkeypatch):
    """Texts of the same words in another case and with other marks have no new piece for the model but the marks."""
    tok = PieceEncoder(NAME, added=True)
    names = ["".join(random.Random(k).choices("abcdefgéö", k=9)) for k in range(500)]
    ids(tok, [" ".join(names) + ". , ; \" 1 2"])
    sent = []
    raw = PieceEncoder._raw
    monkeypatch.setattr(PieceEncoder, "_raw", lambda self, texts, *more: sent.extend(texts) or raw(self, texts, *more))
    text = "".join(f'{a.capitalize()},{b.upper()}.\n"{c}"; 12 ' for a, b, c in zip(names, names[1:], names[2:]))
    assert ids(tok, [text]) == library_ids(NAME, [text])
    assert set(sent) <= {'"', '";', '."', "."}


def test_numbers_of_hashes():
    """As a dictionary, with hashes that share slots and while the table grows."""
    rng = np.random.default_rng(2)
    table, want = tokens.Numbers(), {}
    for _ in range(8):
        names = np.unique(rng.integers(1, 1 << 40, 20_000, dtype=U64) >> U64(20) | rng.integers(0, 8, 20_000, dtype=U64) << U64(60))
        new = names[table.get(names) == tokens._MISSING]
        assert not set(new.tolist()) & set(want) and len(names) - len(new) == len(set(names.tolist()) & set(want))
        values = np.arange(len(want), len(want) + len(new))
        table.put(new, values)
        want |= dict(zip(new.tolist(), values.tolist()))
        assert table.get(names).tolist() == [want[x] for x in names.tolist()]
    every = np.array(list(want), dtype=U64)
    assert table.get(every).tolist() == list(want.values())
