"""Vectorised text kernel: words and rolling hashes of many documents at once.

A batch of texts is handled as one byte buffer with row offsets.  Words are
maximal runs of bytes outside a separator table, so every rule that is defined
on ASCII separators works on UTF-8 without decoding.  Each word gets a 64-bit
hash from one prefix sum over the bytes, and every window of words gets one
from a prefix sum over the word hashes, so the cost per byte does not depend
on the number or length of the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64

#: Separators of "[^\x20\x09-\x0D]+".
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes outside "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" (after A-Z became a-z).
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Byte to byte, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# Multipliers of bytes in a word and of words in a window; the second pair gives hashes independent of the first.
_BYTES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORDS = 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CODES = [mix(np.arange(1, 257, dtype=U64) * U64(b)) for b in _BYTES]


def _run(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


@lru_cache(maxsize=8)
def _cached(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _run(base, n), _run(pow(base, -1, 1 << 64), n)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    if n <= CHUNK_BYTES:
        up, down = _cached(base, CHUNK_BYTES)
        return up[:n], down[:n]
    return _run(base, n), _run(pow(base, -1, 1 << 64), n)


class Texts:
    """Some rows' texts: bytes and n + 1 offsets; null counts as empty."""

    __slots__ = ("data", "offsets", "lo")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int = 0):
        self.data, self.offsets, self.lo = data, offsets, lo

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> str:
        return self.raw(row).decode("utf-8", "replace")

    def raw(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    @classmethod
    def of(cls, values: list[str | None]) -> "Texts":
        return next(iter(chunks(pa.array(values, pa.string()), 1 << 62)), cls(np.zeros(0, np.uint8), np.zeros(1, np.int64)))


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The rows of an Arrow string column in pieces of about `limit` bytes; a longer text is a piece of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ is not None and bytes_.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


class Words:
    """The words of some texts: byte starts and ends, row of each, and first word of each row."""

    __slots__ = ("texts", "starts", "ends", "row", "first", "_hash", "_prefix")

    def __init__(self, texts: Texts, separators: np.ndarray, fold: bool = False):
        data, offsets = texts.data, texts.offsets
        if fold:
            data = LOWER[data]
            texts = Texts(data, offsets, texts.lo)
        self.texts = texts
        inside = ~separators[data]
        n = len(data)
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1]
        before[edges[edges < n]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        edges = offsets[1:][np.diff(offsets) > 0]
        after[edges - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._hash, self._prefix = [None, None], [None, None]

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        """64 bits for each word, from its bytes."""
        return self._hashes(0)

    def _hashes(self, k: int) -> np.ndarray:
        """Sums over bytes are held for one block at a time."""
        if self._hash[k] is None:
            data, base = self.texts.data, _BYTES[k]
            out, down = np.zeros(len(self), dtype=U64), np.zeros(len(self), dtype=U64)
            carry = U64(0)
            for lo in range(0, len(data), CHUNK_BYTES):
                part = data[lo : lo + CHUNK_BYTES]
                up, back = powers(base, len(part))
                total = np.zeros(len(part) + 1, dtype=U64)
                np.cumsum(_CODES[k][part] * up, out=total[1:])
                total *= U64(pow(base, lo, 1 << 64))
                total += carry
                i, j = np.searchsorted(self.starts, [lo, lo + len(part)])
                at = self.starts[i:j] - lo
                out[i:j] -= total[at]
                down[i:j] = back[at] * U64(pow(base, -lo, 1 << 64))
                i, j = np.searchsorted(self.ends, [lo, lo + len(part)], side="right")
                out[i:j] += total[self.ends[i:j] - lo]
                carry = total[-1]
            self._hash[k] = mix(out * down + (self.ends - self.starts).astype(U64))
        return self._hash[k]

    def span(self, start: np.ndarray, length, other: bool = False) -> np.ndarray:
        """64 bits for each run of `length` words from `start`, from the words' hashes in order; `other` gives a second, independent 64."""
        k = int(other)
        if self._prefix[k] is None:
            up, down = powers(_WORDS[k], len(self) + 1)
            total = np.zeros(len(self) + 1, dtype=U64)
            np.cumsum(self._hashes(k) * up[: len(self)], out=total[1:])
            self._prefix[k] = total, down
        total, down = self._prefix[k]
        return mix((total[start + length] - total[start]) * down[start] + np.asarray(length).astype(U64))

    def window_starts(self, length: int) -> np.ndarray:
        """Word indices at which `length` words of one row begin."""
        n = len(self) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.row[:n] == self.row[length - 1 :])

    def joined(self, keep: np.ndarray | None = None) -> Texts:
        """The kept words of each row, joined by one space."""
        data, starts, ends, row = self.texts.data, self.starts, self.ends, self.row
        if keep is not None:
            starts, ends, row = starts[keep], ends[keep], row[keep]
        n = len(data)
        step = np.zeros(n + 1, dtype=np.int8)
        step[starts] += 1
        step[ends] -= 1
        inner = ends[:-1][row[1:] == row[:-1]]
        taken = np.cumsum(step[:n], dtype=np.int8).view(bool)
        taken[inner] = True
        out = data.copy()
        out[inner] = 0x20
        if len(self.texts) == 1:
            return Texts(out[taken], np.array([0, np.count_nonzero(taken)]), self.texts.lo)
        lengths = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(taken, out=lengths[1:])
        return Texts(out[taken], lengths[self.texts.offsets], self.texts.lo)


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n positions lie in any run [start, start + length)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:n]) > 0


def by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive entries of `first`."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])
