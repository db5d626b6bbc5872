"""Vectorised text helpers used inside tasks: bytes, words, lines and their 64-bit hashes.

Texts are handled as the bytes of an Arrow column, in slices of about a megabyte, so that
memory does not depend on the size of a batch. Every hash of a span joins two polynomials over the bytes
(or over word hashes), one modulo 2**64 and one modulo the prime 2**31 - 1, read off prefix sums, by a bit mixer. The
first alone would give equal hashes to long texts of a certain regular form, whatever its base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
CACHE_BYTES = 1 << 16  # with slices of this size the arrays of 64-bit values stay in a core's cache

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
_PRIME, _SMALL_BASE = (1 << 31) - 1, 1_220_703_125


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


SPACE = _table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
NOT_LEADING = _table((0x80, 0xBF))  # bytes that continue a code point


def _grown(n: int, name: str) -> int:
    """A size for a table of powers that needs n: twice the last one at least, so that few sizes are built."""
    return max(n, 2 * len(_powers.get(name, ())), 2 * CACHE_BYTES)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = _grown(n, "up")
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the second base and of its inverse, modulo the prime."""
    if "up_prime" not in _powers or len(_powers["up_prime"]) < n:
        size = _grown(n, "up_prime")
        for name, base in (("up_prime", _SMALL_BASE), ("down_prime", pow(_SMALL_BASE, -1, _PRIME))):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), _PRIME)) % np.uint64(_PRIME)])
            _powers[name] = p[:size]
    return _powers["up_prime"][:n], _powers["down_prime"][:n]


def _prime_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The second polynomial of each span. A product is folded once, to 32 bits, so that sums stay exact."""
    prime, n = np.uint64(_PRIME), len(values)
    up, down = prime_powers(n + 1)
    terms = values & prime
    terms *= up[:n]
    high = terms >> np.uint64(31)
    terms &= prime
    terms += high
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(terms, out=sums[1:])
    return (sums[ends] - sums[starts]) % prime * down[starts] % prime


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place where possible)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span [start, end) of a sequence of 64-bit values."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h += mix(_prime_hashes(values, starts, ends))
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE_VALUES[data], starts, ends)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their bytes and row offsets; a null text is empty.

    Yields (first row, end row, bytes, offsets); a range holds at most `limit` bytes, or
    one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where the words of each row begin.

    A word is a run of bytes outside `space`; a row boundary ends it.
    """
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    np.logical_not(space[data], out=inside[:n])
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:]
    end = np.zeros(n + 1, dtype=bool)
    end[1:] = inside[:-1] & (~inside[1:] | cut[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `flags` over each row range."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row number of each element, from row bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(words: np.ndarray, bounds: np.ndarray, size: int
            ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a row, and the first word of each."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = row_of(bounds)
    first = np.flatnonzero(row[:len(words) - size + 1] == row[size - 1:])
    h = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):  # Horner's rule over the word hashes
        h *= _BASE
        h += words[k:len(words) - size + 1 + k]
    return mix(h[first]), first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
