"""Lines of whole texts and hashes of their keys, straight from Arrow's UTF-8 buffers.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import shingles as S


@dataclass
class Lines:
    """The lines of a block of texts, in order: text, bounds of the whole line and of its key, code points and hash of the key."""

    at: int
    texts: int
    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    points: np.ndarray
    hash: np.ndarray

    def key(self, i: int) -> bytes:
        return self.data[self.key_start[i] : self.key_end[i]].tobytes().lower()


def lines(array: pa.Array) -> Iterator[Lines]:
    raw, offsets = S.utf8(array)
    for a, b in S._blocks(offsets):
        data, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n, size = b - a, len(data)
        breaks = np.flatnonzero(data == 10)
        text = np.concatenate((np.arange(n), np.searchsorted(off, breaks, "right") - 1))
        start = np.concatenate((off[:-1], breaks + 1))
        order = np.lexsort((start, text))
        text, start = text[order], start[order]
        end = off[text + 1].copy()
        same = text[1:] == text[:-1]
        end[:-1][same] = start[1:][same] - 1
        # a key runs from the first word that begins in the line to the last that ends in it; \n is white space, so none crosses lines
        word_start, word_end = S.word_bounds(data, off) if size else (np.zeros(0, np.int64),) * 2
        key_start = np.minimum(np.append(word_start, size)[np.searchsorted(word_start, start)], end)
        key_end = np.maximum(np.concatenate(([0], word_end))[np.searchsorted(word_end, end, "right")], key_start)
        hashes = S.segment_hashes(data, key_start, key_end)
        yield Lines(a, n, data, text, start, end, key_start, key_end, _points(data, key_start, key_end), hashes)


def _points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of the byte runs, counted for at most S.BLOCK_BYTES at a time."""
    before = np.zeros(2 * len(starts), np.int64)
    places = np.stack((starts, ends), axis=1).ravel()
    total = i = 0
    for at in range(0, len(data) + 1, S.BLOCK_BYTES):
        j = int(np.searchsorted(places, at + S.BLOCK_BYTES))
        upto = np.concatenate(([0], np.cumsum((data[at : at + S.BLOCK_BYTES] & 0xC0) != 0x80)))
        before[i:j] = total + upto[places[i:j] - at]
        total, i = total + int(upto[-1]), j
    return before[1::2] - before[::2]
