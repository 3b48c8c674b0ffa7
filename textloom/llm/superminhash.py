"""SuperMinHash signatures of sets of 64-bit hashes, many sets at once.

Every element draws a random permutation of the slots, one position at a time: at step j it offers j plus a random
fraction to the slot that stands j-th in its permutation, and a slot keeps the least offer. A set is finished as soon
as all its slots hold offers of earlier steps, since later ones cannot be less: large sets stop after one or two steps.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Elements whose permutations are held at a time.
ELEMENTS = 1 << 16


def _draw(x: np.ndarray, step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(x + np.uint64(((step + 1) * int(_STEP)) % 2**64))
    return (((r >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64), r & np.uint64(0xFFFFFFFF)


def signatures(elements: np.ndarray, begins: np.ndarray, slots: int) -> np.ndarray:
    """An int64 row of slots for each set elements[begins[i]:begins[i + 1]]: 32 bits of fraction under the step. Empty sets get -1."""
    n = len(begins) - 1
    sizes = np.diff(begins)
    held = np.full(n * slots, np.iinfo(np.int64).max, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    at, fraction = _draw(elements, 0, slots)
    np.minimum.at(held, owner * slots + at, fraction.astype(np.int64))
    held = held.reshape(n, slots)
    open_sets = np.flatnonzero((held.max(axis=1, initial=0) >= 1 << 32) & (sizes > 0))
    i = 0
    while i < len(open_sets):
        to = i + max(1, int(np.searchsorted(np.cumsum(sizes[open_sets[i : i + ELEMENTS]]), ELEMENTS, "right")))
        _finish(elements, begins, held, open_sets[i:to], slots)
        i = to
    held[sizes == 0] = -1
    return held


def _finish(elements: np.ndarray, begins: np.ndarray, held: np.ndarray, sets: np.ndarray, slots: int) -> None:
    x = np.concatenate([elements[begins[s] : begins[s + 1]] for s in sets])
    owner = np.repeat(np.arange(len(sets)), begins[sets + 1] - begins[sets])
    mine = held[sets]
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(x), 1))
    rows = np.arange(len(x))
    for step in range(slots):
        at, fraction = _draw(x, step, slots - step)
        at += step
        chosen = order[rows, at]
        order[rows, at] = order[:, step]
        if step:
            np.minimum.at(mine.reshape(-1), owner * slots + chosen, (step << 32) + fraction.astype(np.int64))
            live = mine.max(axis=1) >= (step + 1) << 32
            if not live.any():
                break
            keep = live[owner]
            if keep.sum() < 0.7 * len(keep):
                x, owner, order = x[keep], owner[keep], order[keep]
                rows = np.arange(len(x))
    held[sets] = mine
