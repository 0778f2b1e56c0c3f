"""Tokenizing whole texts with a public tokenizer, through a cache of pieces.

Both supported kinds split texts before they merge anything, so a text's ids are its pieces' ids joined, and the same few
hundred thousand pieces make up most of a corpus. Pieces are found at bytes and looked up by their hashes; only new ones become
strings and go to the tokenizer, many at a time, as one text whose ids can be told apart again.

Byte-level vocabularies have words, numbers and marks, each with the space before it, and white space (`byte_units`). Word vocabularies
never merge a letter with anything else and ignore case: lower-cased words, digits, and whatever else stands between them (`units`).
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from unicodedata import normalize

import numpy as np

from .texts import LOWER, U64, Texts, byte_class

#: Pieces kept per worker, and their ids, as scripts without spaces have long pieces; the cache starts afresh beyond that.
CACHE_UNITS, CACHE_IDS = 2_000_000, 1 << 24
#: Bytes of text that callers hand over at once, and new pieces that go to the tokenizer at once and in one text.
TEXT_BYTES = 1 << 20
_AT_ONCE, _JOINED = 8192, 256
_MISSING = -1

#: What `units` relies on: the normalizer and the pre-tokenizer's pattern of word vocabularies. A byte-level pre-tokenizer has its pattern built in:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes. Odd ones are those of characters beyond ASCII but the letters of Latin-1 and the two blocks after it.
_SPACE, _LETTER, _DIGIT, _QUOTE, _SYMBOL, _ODD = range(6)
_KIND = np.select([byte_class((0x20, 0x20), (0x09, 0x0D)), byte_class((0x41, 0x5A), (0x61, 0x7A)), byte_class((0x30, 0x39)), byte_class((0x27, 0x27)),
                   byte_class((0x80, 0xFF))], [_SPACE, _LETTER, _DIGIT, _QUOTE, _ODD], _SYMBOL).astype(np.uint8)
#: Whether texts may be cut between two kinds. A quote may be the head of 's; odd characters may join what stands beside them.
_CUT = np.ones((6, 6), dtype=bool)
_CUT[_ODD, 1:] = _CUT[1:, _ODD] = False
for _a, _b in ((_SPACE, _SPACE), (_LETTER, _LETTER), (_SYMBOL, _SYMBOL), (_SYMBOL, _QUOTE), (_QUOTE, _SYMBOL), (_QUOTE, _QUOTE), (_QUOTE, _LETTER)):
    _CUT[_a, _b] = False
#: The multiplication and division signs, and the I with a dot, of which lower-casing makes a letter and a mark.
_NO_LETTERS = np.array([0xC397, 0xC3B7, 0xC4B0])

#: The same for byte-level vocabularies. The last kind is white space beyond ASCII (and two characters that once were), whose bytes follow.
_BLANK, _WHITE, _WORD, _NUMBER, _MARK, _TICK, _OTHER, _FAR = range(8)
_BYTE_KIND = np.select([byte_class((0x20, 0x20)), byte_class((0x09, 0x0D)), byte_class((0x41, 0x5A), (0x61, 0x7A)), byte_class((0x30, 0x39)),
                        byte_class((0x27, 0x27)), byte_class((0x80, 0xFF))], [_BLANK, _WHITE, _WORD, _NUMBER, _TICK, _OTHER], _MARK).astype(np.uint8)
_FAR_SPACES = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
#: Whether the pattern always ends a match between two kinds. A space belongs to what follows; of white space the last may belong elsewhere.
_BYTE_CUT = np.ones((8, 8), dtype=bool)
_BYTE_CUT[_FAR] = _BYTE_CUT[:, _FAR] = _BYTE_CUT[_BLANK] = _BYTE_CUT[_WHITE, : _WHITE + 1] = False
_BYTE_CUT[_WORD, [_WORD, _OTHER]] = _BYTE_CUT[_NUMBER, [_NUMBER, _OTHER]] = _BYTE_CUT[_MARK, [_MARK, _TICK, _OTHER]] = False
_BYTE_CUT[_TICK, [_WORD, _MARK, _TICK, _OTHER]] = _BYTE_CUT[_OTHER, _WORD:] = False
#: Pieces that can stand in a line of their own among others.
_LINE = re.compile(r" ?\S+")


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts that a word vocabulary's tokenizer never merges, whether they are Latin letters alone, and their bytes.

    White space is in none. The bytes are the texts', in lower case but where there are odd characters.
    """
    kind, low = _KIND[data], LOWER[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    code = data[lead].astype(np.int64) << 8 | data[np.minimum(lead + 1, len(data) - 1)]
    letter = ~np.isin(code, _NO_LETTERS)
    kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
    low[lead[letter & (code <= 0xC39E)] + 1] |= 0x20
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = _CUT.reshape(-1)[kind[:-1] * np.uint8(6) + kind[1:]]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    inside = kind[starts] != _SPACE if len(data) else np.zeros(len(starts), dtype=bool)
    starts, ends = starts[inside], ends[inside]
    plain = kind[starts] == _LETTER
    odd = kind == _ODD
    if odd.any():
        odd = np.append(0, np.cumsum(odd))
        odd = odd[ends] > odd[starts]
        plain &= ~odd
        as_is = _runs(starts[odd], (ends - starts)[odd])
        low[as_is] = data[as_is]
    return starts, ends, plain, low


def byte_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts that a byte-level tokenizer never merges, whether they are one match of its pattern for sure, and the bytes.

    Characters beyond ASCII, but for Latin letters, stay with what stands beside them up to ASCII white space; white space among them also with that.
    """
    if not len(data):
        return bounds[:0], bounds[:0], np.zeros(0, dtype=bool), data
    kind = _BYTE_KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    letter = lead[~np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], _NO_LETTERS)]
    kind[letter] = kind[letter + 1] = _WORD
    for space in _FAR_SPACES if (kind == _OTHER).any() else ():
        at = np.flatnonzero(data[: len(data) - len(space) + 1] == space[0])
        for k in range(1, len(space)):
            at = at[data[at + k] == space[k]]
        for k in range(len(space)):
            kind[at + k] = _FAR
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = _BYTE_CUT.reshape(-1)[kind[:-1] << 3 | kind[1:]]
    end = np.zeros(len(data) + 1, dtype=bool)
    end[bounds] = True
    # Of a run of white space before something else, all but the last is a match.
    last = np.flatnonzero((kind[:-2] <= _WHITE) & (kind[1:-1] <= _WHITE) & (kind[2:] > _WHITE) & (kind[2:] < _FAR)) + 1
    edge[last[~end[last + 1]]] = True
    at = np.flatnonzero(edge | end)
    most = np.maximum.reduceat(kind, at[:-1])
    return at[:-1], at[1:], (most >= _WORD) & (most <= _MARK), data


class Numbers:
    """Numbers by 64-bit hashes: a table of twice as many slots at least, searched from each hash's own slot on."""

    def __init__(self) -> None:
        self.n, self.keys, self.values = 0, np.zeros(1 << 16, dtype=U64), np.zeros(1 << 16, dtype=np.int32)

    def get(self, names: np.ndarray) -> np.ndarray:
        """The names' numbers, _MISSING for others."""
        last = U64(len(self.keys) - 1)
        slot = names & last
        found = self.keys[slot]
        out = np.where(found == names, self.values[slot], _MISSING)
        open_ = np.flatnonzero((found != names) & (found != 0))
        while len(open_):
            slot[open_] = slot[open_] + U64(1) & last
            found = self.keys[slot[open_]]
            hit = found == names[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def put(self, names: np.ndarray, values: np.ndarray) -> None:
        """Add names that differ, none of them 0 or in the table."""
        self.n += len(names)
        if 2 * self.n > len(self.keys):
            old = np.flatnonzero(self.keys)
            names, values = np.append(self.keys[old], names), np.append(self.values[old], values)
            size = 1 << (2 * self.n).bit_length()
            self.keys, self.values = np.zeros(size, dtype=U64), np.zeros(size, dtype=np.int32)
        last = U64(len(self.keys) - 1)
        slot = names & last
        while len(names):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = names[free]  # of several at one slot one stays
            there = self.keys[slot] == names
            self.values[slot[there]] = values[there]
            names, values, slot = names[~there], values[~there], slot[~there] + U64(1) & last


class PieceEncoder:
    """Ids of texts, as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    With `added`, as operators use it, the content of an added token (`<|endoftext|>`) in a text is that token, which is
    the library's default; without, it is plain text, as with `encode_special_tokens`.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path if os.sep in path else public_tokenizers.path(path))
        # Texts are cut at added tokens before their pieces come here, so pieces are always plain.
        self.tokenizer.encode_special_tokens = True
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: added tokens that don't match their plain content are not supported")
        # The library finds them from left to right, the longest first, in the text as it is.
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        vocab = self.tokenizer.get_vocab()
        # Byte-level vocabularies write a space as U+0120 and a line end, which is put behind each piece, as U+010A; word vocabularies end words with a mark.
        self.bytes = "Ġthe" in vocab
        mark = (lambda t: t == "Ċ") if self.bytes else (lambda t: t.endswith("</w>"))
        self.marks = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.marks[[i for t, i in vocab.items() if mark(t)]] = True
        if self.bytes:
            splitter = json.loads(self.tokenizer.pre_tokenizer.__getstate__())
            if self.tokenizer.normalizer or (splitter["type"], splitter["add_prefix_space"], splitter["use_regex"]) != ("ByteLevel", False, True):
                raise ValueError(f"{path}: not the byte-level vocabulary's way to split texts")
            # Pieces that are one match need no pattern.
            lines = pre_tokenizers.Split("\n", "isolated")
        else:
            normalizer, splitter = (json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
            if normalizer.get("normalizers") != _NORMALIZERS or splitter["pretokenizers"][0]["pattern"] != {"Regex": _PATTERN}:
                raise ValueError(f"{path}: not the word vocabulary's way to normalize and to split texts")
            # Lower-cased Latin words are what they are to the normalizer and the pattern, so they go to the same model without these.
            lines = pre_tokenizers.Split(" ", "removed")
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([lines, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        # Ids of all pieces one after another, in as few bytes as the vocabulary needs, and where each piece's begin; the last entry is the end.
        self.pool = np.zeros(1 << 16, dtype=np.min_scalar_type(len(self.marks)))
        self.used = self.n = 0
        self.at = np.zeros(1 << 14, dtype=np.int64)

    def _raw(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _marks_of(self, piece: str) -> int:
        """How many marked ids the piece has when it is one of many in a text; 0: it can't be joined."""
        if self.bytes:
            return int(_LINE.fullmatch(piece) is not None)
        if not piece.isascii():
            piece = normalize("NFC", piece)  # as the tokenizer does; some letters become a letter and a mark
        if piece.isalpha() and piece.lower().isalpha():
            return 1
        return 2 if piece[-1:] in (".", ",", "!") and piece[:-1].isalpha() and piece[:-1].lower().isalpha() else 0

    def _store(self, pieces: list[str], marks: list[int], tokenizer=None) -> tuple[int, list[int]]:
        """Encode pieces, those with marks many at once; their first number in the cache, and which of them have that and those after it."""
        easy, hard = [i for i, c in enumerate(marks) if c], [i for i, c in enumerate(marks) if not c]
        found, sizes, order = [], [], []
        glue = (lambda g: "".join([pieces[i] + "\n" for i in g])) if self.bytes else (lambda g: " ".join([pieces[i] for i in g]))
        groups = [easy[s : s + _JOINED] for s in range(0, len(easy), _JOINED)]
        for group, ids in zip(groups, self._raw([glue(g) for g in groups], tokenizer)):
            ids, ends = np.array(ids, dtype=np.uint32), np.cumsum([marks[i] for i in group])
            places = np.flatnonzero(self.marks[ids])
            if len(places) != ends[-1]:  # not as foreseen: one by one
                hard += group
                continue
            order += group
            found.append(ids[~self.marks[ids]] if self.bytes else ids)
            sizes.append(np.diff(np.append(0, places[ends - 1] + 1)) - int(self.bytes))
        alone = self._raw([pieces[i] for i in hard], tokenizer)
        found += [np.array(x, dtype=np.uint32) for x in alone]
        sizes.append(np.array([len(x) for x in alone], dtype=np.int64))
        ids, lengths = np.concatenate([*found, np.zeros(0, np.uint32)]), np.concatenate(sizes)
        first, self.n = self.n, self.n + len(lengths)
        self.pool = _room(self.pool, self.used + len(ids))
        self.at = _room(self.at, self.n + 1)
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[first + 1 : self.n + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        return first, [*order, *hard]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's number of ids."""
        if not any(content in t for content in self.added for t in texts):
            return self._plain(texts)
        parts, firsts, tokens, places = [], [], [], []
        for t in texts:
            firsts.append(len(parts))
            end = 0
            for m in self.cut.finditer(t):
                parts += [t[end : m.start()], ""]
                places.append(len(parts) - 1)
                tokens.append(self.added[m[0]])
                end = m.end()
            parts.append(t[end:])
        ids, n = self._plain(parts)
        ids = np.insert(ids, np.cumsum(n)[places], np.array(tokens, dtype=ids.dtype))
        n[places] = 1
        return ids, np.add.reduceat(n, firsts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.numbers.n > CACHE_UNITS or self.used > CACHE_IDS:
            self.clear()
        return self._joined(*self._units(texts))

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The cache's number of each unit, and each text's number of units. Only new ones become strings."""
        data, bounds = _bytes(texts)
        starts, ends, plain, low = (byte_units if self.bytes else units)(data, bounds)
        part = Texts(low, bounds)
        names = np.maximum(part.hashes(part.prefix_hash(), starts, ends), U64(1))
        index = self.numbers.get(names)
        missing = np.flatnonzero(index == _MISSING)
        if len(missing):
            new, where = np.unique(names[missing], return_index=True)
            where = missing[where]
            for some, tokenizer in ((plain[where], self.words), (~plain[where], None)):
                chosen, named, raw = where[some], new[some], low.tobytes()
                for k in range(0, len(chosen), _AT_ONCE):
                    at = chosen[k : k + _AT_ONCE]
                    strings = [raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())]
                    if tokenizer:
                        marks = [1] * len(strings)
                        if not self.bytes:
                            strings = [x.lower() for x in strings]  # letters beyond Latin-1 are as they were
                    else:
                        marks = [self._marks_of(x) for x in strings]
                    first, order = self._store(strings, marks, tokenizer)
                    self.numbers.put(named[k : k + _AT_ONCE][order], np.arange(first, self.n))
            index[missing] = self.numbers.get(names[missing])
        return index, np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])

    def _joined(self, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts with so many pieces each, and each text's number of ids."""
        starts = self.at[index]
        lengths = self.at[index + 1] - starts
        total = np.append(0, np.cumsum(lengths))
        ends = np.cumsum(counts, dtype=np.int64)
        return self.pool[_runs(starts, lengths)].astype(np.uint32), total[ends] - total[ends - counts]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs of such lengths that begin at such starts."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and each text's bounds there."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


@lru_cache(maxsize=4)
def encoder(path: str, added: bool = False) -> PieceEncoder:
    """One encoder per worker process, file and treatment of added tokens."""
    return PieceEncoder(path, added)
