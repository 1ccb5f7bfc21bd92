"""Words of whole texts as 64-bit hashes, a bounded piece of bytes at a time, in numpy.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}; these bytes never occur inside a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _cached_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _cached_powers(base, 1 << max(12, (n - 1).bit_length()))[:n] if n <= 1 << 22 else np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@lru_cache(maxsize=2)
def _values(lower: bool) -> np.ndarray:
    v = np.arange(256, dtype=np.uint64) + np.uint64(1)
    if lower:
        v[0x41:0x5B] = v[0x61:0x7B]
    v = mix(v)
    v[_SPACE] = 0
    return v


def bounds(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end; `breaks` are offsets that no word crosses."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    if breaks is not None:
        cut = breaks[(breaks > 0) & (breaks < len(data))]
        first[cut] |= solid[cut]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    return starts, np.flatnonzero(last) + 1


def _hash_piece(data: np.ndarray, starts: np.ndarray, lower: bool) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    value = _values(lower)[data]
    value *= powers(_BASE, len(data))
    out = np.add.reduceat(value, starts)
    out *= powers(inverse(_BASE), len(data))[starts]
    return mix(out)


def hash_words(data: np.ndarray, lower: bool = False, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a byte array, made in pieces of about PIECE_BYTES that end at word ends."""
    starts, ends = bounds(data, breaks)
    if len(data) <= PIECE_BYTES:
        return _hash_piece(data, starts, lower), starts, ends
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        lo, hi = starts[at], ends[to - 1]
        out.append(_hash_piece(data[lo:hi], starts[at:to] - lo, lower))
        at = to
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), starts, ends


def text_pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of these rows) over runs of whole texts of about PIECE_BYTES; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, body = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        to = min(to, n)
        lo = offsets[at]
        yield at, to, data[lo : offsets[to]], offsets[at : to + 1] - lo
        at = to


def hashed_texts(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word offsets of these rows) for runs of whole texts."""
    for at, to, data, offsets in text_pieces(texts):
        hashes, starts, _ = hash_words(data, lower, offsets[1:-1])
        yield at, to, hashes, np.searchsorted(starts, offsets)


def rolled(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of each run of k words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(seed | 1)
    with np.errstate(over="ignore"):
        for j in range(k):
            out *= factor
            out += hashes[j : j + n]
    return mix(out)
