"""Vectorised words and rolling hashes over the UTF-8 bytes of Arrow string columns.

A batch's texts lie one after another in one byte buffer, so words, word hashes and n-gram hashes of
thousands of texts come out of a few numpy passes. Polynomial hashes are taken modulo 2**64 and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes, so that numpy temporaries stay bounded.
SLICE_BYTES = 4 << 20
#: Words are hashed in pieces of about so many bytes: the numbers and powers of a piece take 32 bytes for each of them.
PIECE_BYTES = 1 << 18

U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_GRAM_BASES = (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words that white space alone divides.
SPACED = ~_space
#: Bytes of words of lower-cased letters and digits: 0-9, a-z, and all that isn't ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True
#: Lower-cases A-Z in UTF-8 bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    got = _tables.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        got = _tables[base] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return got


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of values[starts[i]:ends[i]]."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], dtype=U, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Texts:
    """A run of texts as bytes: `data`, and `offsets` with one more entry than there are texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, kind: np.ndarray, lower: bool = False) -> "Words":
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind[data]
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        first[cut] |= inside[cut + 1]
        last[cut - 1] |= inside[cut]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return Words(data, starts, ends, np.searchsorted(starts, self.offsets))


class Words:
    """Words of a run of texts; text i has words bounds[i]:bounds[i + 1]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.data, self.starts, self.ends, self.bounds = data, starts, ends, bounds

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, which: int = 0) -> np.ndarray:
        out, at = np.empty(len(self), U), 0
        while at < len(self):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + PIECE_BYTES, "right")))
            values = self.data[low : self.ends[to - 1]].astype(U) + U(1)
            out[at:to] = _ranges(values, self.starts[at:to] - low, self.ends[at:to] - low, _BASES[which])
            at = to
        return out

    def coded(self) -> pa.DictionaryArray:
        """The words, as codes of the different ones."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] += 1  # no two words start, or end, at one place
        inside[self.ends] -= 1
        letters = self.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()

    def texts(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def grams(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each `size` neighbouring entries; texts' bounds are the caller's matter. Empty if too few."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return _ranges(hashes, at, at + size, _GRAM_BASES[which])


def within(bounds: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the first n places can start a run of `size` words inside one text."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + size <= end[:n]


def slide(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each `width` neighbouring values, in log(width) passes."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = of(values[: len(values) - step], values[step:])
        have += step
    return values


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, Texts) for runs of rows of about `limit` bytes. Null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
