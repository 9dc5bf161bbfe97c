"""Vectorised hashing of byte and word sequences (numpy), shared by the operators on texts.

A sequence is an array of 64-bit symbols. Prefix sums of symbol * base**i give the hash of any
run of symbols from two look-ups, whatever its length; equal runs have equal hashes wherever they
start. Arithmetic wraps modulo 2**64 and a finaliser spreads the bits.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np

def tidy() -> None:
    """Gives freed memory back to the system: called at the end of a task, as its worker lives on for others."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


with contextlib.suppress(OSError, AttributeError):
    # glibc: keep freed buffers of up to 4 MB within a task; giving pages back and faulting them in again took most of the time
    for option, value in ((-1, 1 << 25), (-3, 1 << 22)):
        ctypes.CDLL("libc.so.6").mallopt(option, value)

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random symbol for each byte value.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: White space that separates words: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Maps A-Z to a-z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_power = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, U)
        have[0] = 1
        done = 1
        while done < size:  # doubling: powers of the second half are those of the first times base**done
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U(pow(base, done, 2**64))
            done += step
        _power[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of ``x``, in place; one buffer, as new pages cost more than the arithmetic."""
    t = np.right_shift(x, U(31))
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, U(0xBF58476D1CE4E5B9), out=x)
    np.right_shift(x, U(27), out=t)
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, U(0x94D049BB133111EB), out=x)
    np.right_shift(x, U(30), out=t)
    np.bitwise_xor(x, t, out=x)
    return x


class Runs:
    """Hashes of runs of one symbol sequence."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        self.sums = np.zeros(n + 1, U)
        np.multiply(symbols, _powers(_BASE, max(n, 1))[:n], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])
        self.back = _powers(_INV, n + 1)

    def each(self, length: int) -> np.ndarray:
        """Hash of every run of ``length`` symbols, by its start."""
        if self.n < length:
            return np.zeros(0, U)
        x = self.sums[length:] - self.sums[: self.n - length + 1]
        x *= self.back[: self.n - length + 1]
        return mix(x)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.sums[end]
        x -= self.sums[start]
        x *= self.back[start]
        return mix(x)


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the words of several texts that lie in one buffer.

    ``starts``/``ends``: byte range of each text in ``data``. Returns the words' hashes, first bytes and
    end bytes, and for each text the number of words before it (one more entry than texts).
    """
    n = len(data)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[ends] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:n]
    first = np.flatnonzero(opens)
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:n]
    last = np.flatnonzero(closes) + 1
    hashes = Runs(BYTE[data]).of(first, last) if len(first) else np.zeros(0, U)
    before = np.searchsorted(first, np.append(starts, n if len(ends) == 0 else ends[-1]))
    return hashes, first, last, before


def chunks(column, limit: int = 1 << 16):
    """Pieces of an Arrow string column of about ``limit`` bytes: (first row, buffer, starts, ends); nulls are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        kind = np.int64
    else:
        column = column.cast(pa.binary())
        kind = np.int32
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        low = offsets[i]
        yield i, data[low : offsets[j]], offsets[i:j] - low, offsets[i + 1 : j + 1] - low
        i = j


def ahead(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each run of ``w`` entries by doubling: len(x) - w + 1 results."""
    y, k = x.copy(), 1
    while 2 * k <= w:
        y = f(y[:-k], y[k:])
        k *= 2
    n = len(x) - w + 1
    return f(y[:n], y[w - k : w - k + n]) if k < w else y


def whole(n: int, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``n - length + 1`` runs of ``length`` entries lie within one text."""
    step = np.zeros(n + 2, np.int32)
    fits = ends - starts >= length
    np.add.at(step, starts[fits], 1)
    np.add.at(step, ends[fits] - length + 1, -1)
    return np.cumsum(step[: max(0, n - length + 1)]) > 0


def anchors(h: np.ndarray, w: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Entries that are the least in some (valid) run of ``w`` entries, ties included.

    The choice depends on the run alone, so equal runs choose at the same offset, and each run has a choice.
    """
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    least = ahead(h, w, np.minimum)
    if valid is not None:
        least[~valid] = 0
    pad = np.zeros(len(least) + 2 * (w - 1), U)
    pad[w - 1 : w - 1 + len(least)] = least
    most = ahead(pad, w, np.maximum)
    return np.flatnonzero((most[:n] == h) & (h > 0))
