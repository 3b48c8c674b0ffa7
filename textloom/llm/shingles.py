"""Word shingles of whole texts as 64-bit hashes, straight from Arrow's UTF-8 buffers.

Words are runs of bytes other than ASCII white space; A-Z count as a-z. No string is made for a word: a word's hash is
a polynomial over its bytes, got for all words at once from prefix sums modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed together until their bytes pass this; a longer text makes a block of its own, hashed piece by piece.
BLOCK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, n at most BLOCK_BYTES + 1."""
    if base not in _powers:
        have = np.full(BLOCK_BYTES + 1, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return _powers[base][:n]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the disjoint byte runs data[start:end], given in order; held for at most BLOCK_BYTES at a time."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        if high - low <= BLOCK_BYTES:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[data[low:high]] * _power(_BASE, high - low), out=sums[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[b] - sums[a]) * _power(_INVERSE, high - low + 1)[a]
        else:
            total = 0
            for at in range(low, high, BLOCK_BYTES):
                piece = _BYTE[data[at : min(at + BLOCK_BYTES, high)]]
                total += int((piece * _power(_BASE, len(piece))).sum(dtype=np.uint64)) * pow(_BASE, at - low, 2**64)
            out[i] = np.uint64(total % 2**64)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end; off: the texts' offsets in data."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(array: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: the first text's place, the hashes of the words, and where each text's words begin (one more than texts)."""
    raw, offsets = utf8(array)
    for a, b in _blocks(offsets):
        data, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if not len(data):
            yield a, np.zeros(0, np.uint64), np.zeros(b - a + 1, np.int64)
            continue
        starts, ends = word_bounds(data, off)
        yield a, segment_hashes(data, starts, ends), np.searchsorted(starts, off).astype(np.int64)


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words in one text's words; of fewer words, the whole sequence as one; of none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    w = min(width, n)
    total = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        total += hashes[i : n - w + 1 + i] * _PLACE[i % 16]
    return mix(total)


def block_shingles(hashes: np.ndarray, begins: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each text's shingles in turn, with their repeats and in order."""
    if len(hashes) >= width:
        total = np.full(len(hashes) - width + 1, width, np.uint64)
        for i in range(width):
            total += hashes[i : len(hashes) - width + 1 + i] * _PLACE[i % 16]
        total = mix(total)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        yield total[a : b - width + 1] if b - a >= width else shingles_of(hashes[a:b], width)
