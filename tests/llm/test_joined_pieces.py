import numpy as np
import pytest
from test_added_tokens import FILES, library_ids

from lodestrand.llm.tokens import PieceEncoder

WORDS = ["\u09b9\u09df", "\u0958", "\ufb1d", "plain", "words"]


@pytest.mark.parametrize("name", FILES)
def test_letters_that_gain_a_mark(name):
    texts = [" ".join(WORDS), "\u0958, \ufb1d. x"]
    ids, n = PieceEncoder(name, added=True).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library_ids(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_unforeseen_marks(name, monkeypatch):
    """A group whose marks don't add up is encoded one by one."""
    monkeypatch.setattr(PieceEncoder, "_marks_of", lambda self, piece: 1)
    texts = ["some don't fit, others do", "a.b c"]
    tok = PieceEncoder(name, added=True)
    tok.marks[:] = False
    ids, n = tok.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library_ids(name, texts)
