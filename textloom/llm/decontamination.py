"""Benchmark decontamination: SimHash windows of each item's size, multi-index Hamming blocks, exact verification.

Every benchmark item and every window of its number of words in a document gets a 64-bit SimHash of its five-word
shingles, weighted by how often they stand in it. Fingerprints are cut into BLOCKS blocks; two within RADIUS bits agree
within RADIUS // BLOCKS bits in at least one block, and a table for each block value lists the items so near, so no
item within the radius is missed. Candidates are verified by the generalised Jaccard similarity of the weighted
shingles themselves. A window is fingerprinted only where enough of its shingles stand in some item: fewer cannot
reach the threshold, whatever their fingerprint. At a similarity of 0.8 fingerprints of 64 bits differ by 9.7 bits on
average with a deviation of 2.9, so RADIUS is 4.6 deviations beyond. This holds while no shingle repeats: a repeated one
turns many bits at once. Where a window or an item has repeated shingles no fingerprint decides: the intersection of
every window with every item that could reach the threshold is counted exactly, in one pass over the places they share.

Documents are only mapped over; nothing is shuffled. Items are broadcast in parts of at most PART_BYTES and PART_ITEMS,
one pass over the documents a part: this is made for benchmarks of up to some ten thousand items.

Defined cases: items and texts without words (or null) match nothing; an item of fewer than five words is one shingle
and matches the same words only; a document shorter than an item is compared as a whole; a null doc_id or item_id stays
null; of windows equally like an item the first counts; rows that repeat are each found, items that repeat as well; very
long texts are hashed piece by piece and whole; an empty table of documents gives no rows, an empty benchmark drops
none; without_benchmark() carries a row as one value, so no further column clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as S
from .common import bounded_batches, table

WIDTH = 5
PERCENT = 80
RADIUS, BLOCKS = 23, 4
#: Items of one size in a block table (8 MB for 256, 0.25 MB for up to eight), and bytes of tables that a worker holds:
#: more are built anew when they are needed again.
CHUNK = 256
TABLE_BYTES = 24 << 20
PART_BYTES, PART_ITEMS = 8 << 20, 4096


def simhash(windows: np.ndarray) -> np.ndarray:
    """Fingerprints of sums of signs, one row of 64 a window."""
    return np.packbits(windows > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def signs(grams: np.ndarray) -> np.ndarray:
    return np.unpackbits(grams.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _repeated(order: np.ndarray, fresh: np.ndarray, m: int) -> np.ndarray:
    """Whether each window of m places holds a value twice. order sorts the values stably; fresh marks each one's first."""
    n = len(order)
    again = np.full(n, n, np.int64)
    twice = np.flatnonzero(~fresh)
    again[order[twice - 1]] = order[twice]
    return np.minimum.accumulate(again[::-1])[::-1][: n - m + 1] < np.arange(n - m + 1) + m


class _Chunk:
    """Block tables of up to CHUNK fingerprints, and their items by shingle."""

    def __init__(self, prints: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]):
        self.prints = prints
        grams = np.concatenate([g for g, _ in weights])
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.holders = np.repeat(np.arange(len(weights)), [len(g) for g, _ in weights])[order]
        self.counts = np.concatenate([n for _, n in weights])[order]
        self.totals = np.array([int(n.sum()) for _, n in weights], np.int64)
        self.repeats = np.array([bool((n > 1).any()) for _, n in weights], bool)
        near = np.array([0] + [sum(1 << b for b in c) for k in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(16), k)], np.uint16)
        self.table = np.zeros((BLOCKS, 1 << 16, (len(prints) + 7) // 8), np.uint8)
        for i, p in enumerate(prints.tolist()):
            for b in range(BLOCKS):
                self.table[b, near ^ np.uint16((p >> (16 * b)) & 0xFFFF), i >> 3] |= 1 << (i & 7)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in prints, item) within RADIUS bits, through the blocks."""
        found = np.zeros((len(prints), self.table.shape[2]), np.uint8)
        for b in range(BLOCKS):
            found |= self.table[b, ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)]
        w, i = np.nonzero(np.unpackbits(found, axis=1, bitorder="little")[:, : len(self.prints)])
        near = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[near], i[near]

    def exact(self, grams: np.ndarray, order: np.ndarray, fresh: np.ndarray, m: int, only: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, shingles in common with each window of m) of the items of only that enough places of grams share.

        A place adds to a window's intersection if fewer of its value than the item holds stand before it in the window.
        """
        ordered = grams[order]
        first, last = np.searchsorted(self.grams, ordered, "left"), np.searchsorted(self.grams, ordered, "right")
        held = last - first
        k = np.repeat(np.arange(len(order)), held)
        row = np.arange(len(k)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(first, held)
        own = only[self.holders[row]]
        k, row = k[own], row[own]
        item, count, at = self.holders[row], self.counts[row], order[k]
        back = k - count
        # the place from which on so many of the value stand before this one
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        before = np.where(back >= begin[k], order[np.maximum(back, 0)], -1)
        low = np.maximum(np.maximum(before + 1, at - m + 1), 0)
        by_item = np.argsort(item, kind="stable")
        bounds = np.searchsorted(item[by_item], np.arange(len(self.totals) + 1))
        n = len(grams) + 1
        for i in np.flatnonzero(np.diff(bounds) * (100 + PERCENT) >= PERCENT * (m + self.totals)).tolist():
            mine = by_item[bounds[i] : bounds[i + 1]]
            yield i, np.cumsum(np.bincount(low[mine], minlength=n) - np.bincount(at[mine] + 1, minlength=n))[: n - m]


class Items:
    """The index of one part of the benchmark; tables are built where they are used."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, self.sizes, self.weights = [], [], []
        texts = pa.array([t for _, t in rows], pa.string())
        for at, hashes, begins in S.words(texts):
            for j, grams in enumerate(S.block_shingles(hashes, begins, WIDTH)):
                if len(grams):
                    self.ids.append(rows[at + j][0])
                    self.sizes.append(int(begins[j + 1] - begins[j]))
                    self.weights.append(np.unique(grams, return_counts=True))
        self.known = np.unique(np.concatenate([g for g, _ in self.weights])) if self.weights else np.zeros(0, np.uint64)
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(self.known >> np.uint64(42)).astype(np.int64)] = True
        prints = np.array([int(simhash((signs(g) * n[:, None]).sum(axis=0, keepdims=True))[0]) for g, n in self.weights], np.uint64)
        self.by_size: dict[int, list[int]] = {}
        for i, size in enumerate(self.sizes):
            self.by_size.setdefault(size, []).append(i)
        self.prints = prints
        self._chunks: dict[tuple[int, int], _Chunk] = {}

    def __getstate__(self):
        return self.__dict__ | {"_chunks": {}}

    def chunks(self, size: int) -> Iterator[tuple[list[int], _Chunk]]:
        """The tables of the items of one size; the least recently used make room for others."""
        items = self.by_size[size]
        for i in range(0, len(items), CHUNK):
            own = items[i : i + CHUNK]
            chunk = self._chunks.pop((size, i), None) or _Chunk(self.prints[own], [self.weights[j] for j in own])
            self._chunks[size, i] = chunk
            held = sum(c.table.nbytes for c in self._chunks.values())
            while held > TABLE_BYTES and len(self._chunks) > 1:
                held -= self._chunks.pop(next(iter(self._chunks))).table.nbytes
            yield own, chunk

    def hits(self, grams: np.ndarray) -> np.ndarray:
        found = self.gate[(grams >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(found)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
            found[at] = self.known[place] == grams[at]
        return found

    def matches(self, words: np.ndarray, grams: np.ndarray) -> dict[int, tuple[float, int]]:
        """The best window of each item that one text holds: similarity and first word."""
        best: dict[int, tuple[float, int]] = {}
        hit = self.hits(grams)
        some = hit.any()
        for size in self.by_size:
            if size < WIDTH:
                if len(words) >= size:
                    own = grams if len(words) == size else S.mix(sum((words[i : len(words) - size + 1 + i] * S._PLACE[i] for i in range(size)), np.full(len(words) - size + 1, size, np.uint64)))
                    self._verify(own, np.flatnonzero(self.hits(own)), 1, size, best)
            elif some:
                m = min(size, len(words)) - WIDTH + 1
                if m < 1:
                    continue
                upto = np.concatenate(([0], np.cumsum(hit)))
                full = size - WIDTH + 1
                # of m shingles in the window and full in the item, so many must be common
                need = -(-PERCENT * (m + full) // (100 + PERCENT))
                self._verify(grams, np.flatnonzero(upto[m:] - upto[:-m] >= need), m, size, best)
        return best

    def _verify(self, grams: np.ndarray, starts: np.ndarray, m: int, size: int, best: dict[int, tuple[float, int]]) -> None:
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1) if len(starts) else ():
            low = run[0]
            here = grams[low : run[-1] + m]
            order = np.argsort(here, kind="stable")
            fresh = np.concatenate(([True], here[order[1:]] != here[order[:-1]]))
            repeated = _repeated(order, fresh, m)[run - low].any()
            prints = None
            for own, chunk in self.chunks(size):
                only = chunk.repeats | repeated
                if only.any():
                    for i, common in chunk.exact(here, order, fresh, m, only):
                        at = int(np.argmax(common[run - low]))
                        self._take(best, own[i], int(common[run[at] - low]), m, int(run[at]))
                if repeated:
                    continue
                if prints is None:
                    sums = np.zeros((len(here) + 1, 64), np.int32)
                    np.cumsum(signs(here), axis=0, out=sums[1:])
                    prints = simhash(sums[run - low + m] - sums[run - low])
                for w, i in zip(*chunk.within(prints), strict=True):
                    if not only[i]:
                        start = int(run[w])
                        # no shingle repeats on either side
                        common = len(np.intersect1d(grams[start : start + m], self.weights[own[i]][0], assume_unique=True))
                        self._take(best, own[i], common, m, start)

    def _take(self, best: dict[int, tuple[float, int]], item: int, common: int, m: int, start: int) -> None:
        union = m + int(self.weights[item][1].sum()) - common
        if common * 100 >= union * PERCENT and (item not in best or common / union > best[item][0]):
            best[item] = (common / union, start)


def _parts(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in parts of bounded size, by item_id."""
    rows: list[tuple[int, str | None]] = []
    size = 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if rows and (len(rows) >= PART_ITEMS or size + len(r.text or "") > PART_BYTES // 4):
            yield Items(rows)
            rows, size = [], 0
        rows.append((r.item_id, r.text))
        size += len(r.text or "")
    if rows:
        yield Items(rows)


def _scan(array: pa.Array, items: Items) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
    for at, hashes, begins in S.words(array):
        for j, grams in enumerate(S.block_shingles(hashes, begins, WIDTH)):
            if len(grams) and (found := items.matches(hashes[begins[j] : begins[j + 1]], grams)):
                yield at + j, found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words for every item that a document holds, in its best window."""

    bounded_batches(docs.sparkSession)

    def part(items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(r, shared.value.ids[i], round(s, 6), start, shared.value.sizes[i]) for r, found in _scan(batch.column(1), shared.value) for i, (s, start) in sorted(found.items())]
                at, ids, sim, start, n = (list(x) for x in zip(*rows, strict=True)) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(sim, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long")

    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word long, n_words long")
    return reduce(DataFrame.unionByName, (part(x) for x in _parts(benchmark)), empty)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    bounded_batches(docs.sparkSession)
    for items in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(texts: pa.Array, shared=shared) -> pa.Array:
            ok = np.ones(len(texts), bool)
            ok[[r for r, _ in _scan(texts, shared.value)]] = False
            return pa.array(ok)

        flagged = docs.select(F.struct("*").alias("_row"), F.arrow_udf(_typed(clean), "boolean")(F.col("text")).alias("_clean"))
        docs = flagged.where("_clean").select("_row.*")
    return docs


def _typed(f):
    def run(texts: pa.Array) -> pa.Array:
        return f(texts)

    return run


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
