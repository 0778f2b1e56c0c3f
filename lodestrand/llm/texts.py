"""Vectorised views of Arrow text columns: words, lines and windows as numpy arrays of 64-bit hashes.

A batch of texts is one byte array with document bounds. Words are maximal runs of bytes of a class, so
any word rule that can be stated on UTF-8 bytes works, and no Python object is made for a word. The hash
of bytes [s, e) comes from prefix sums of a polynomial over odd powers modulo 2**64, so hashing all words
of a batch costs a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


@lru_cache(maxsize=1)
def _grown(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    return _grown(max(20, int(n).bit_length()))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_NEWLINE = ~byte_class((0x0A, 0x0A))
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Texts:
    """Some texts as one byte array; `bounds` has one entry more than there are texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, row: int = 0):
        self.data, self.bounds, self.row = data, bounds, row

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.bounds, self.row)

    def prefix_hash(self) -> np.ndarray:
        powers, _ = _powers(len(self.data))
        sums = np.empty(len(self.data) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(_BYTE[self.data] * powers[: len(self.data)], out=sums[1:])
        return sums

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of maximal runs of bytes in the class; runs never cross texts."""
        return self.runs_where(table[self.data])

    def runs_where(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of bytes for which `inside` is true."""
        if not len(inside):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts, ends, self.owner(starts)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte run [start, end), equal for equal bytes wherever they stand."""
        _, inverse = _powers(len(self.data))
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(_BASE))


def text_hash(text: str | bytes) -> int:
    """The hash that `Texts.hashes` gives to these bytes."""
    raw = text.encode() if isinstance(text, str) else text
    data = np.frombuffer(raw, dtype=np.uint8)
    one = Texts(data, np.array([0, len(data)]))
    return int(one.hashes(one.prefix_hash(), np.array([0]), np.array([len(data)]))[0])


def windows(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within one text, and the position of each run's first word."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    total = np.zeros(count, dtype=U64)
    for k in range(n):
        total = total * U64(0xD1342543DE82EF95) + words[k : k + count]
    at = np.flatnonzero(owner[:count] == owner[n - 1 :])
    return mix(total[at]), at


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column in order, some MB at a time; nulls are empty texts."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(chunk):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
            yield Texts(whole[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], row + first)
            first = last
        row += len(chunk)
