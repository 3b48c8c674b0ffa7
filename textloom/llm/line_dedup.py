"""Line dedup across documents with two Bloom filters.

1. Workers hash the keys of their long lines into two filters of one size: one of keys seen once, one of keys seen in
   two documents. Merged bit by bit (a bit set by two workers counts as seen twice), no key of two documents can be
   missing from the second filter.
2. That filter is broadcast. Only lines it suspects are shuffled, with their whole key and after
   partial aggregation, to count documents exactly and find the one that keeps them.
3. The repeated keys are then looked up by hash and compared in full. If they fit BROADCAST_BYTES they are broadcast and
   no text moves; else they are joined to their documents.

The filters have four bits for each long line that the texts have room for, FILTER_BITS at most. That bounds memory
(32 MB each), not the result: past about FILTER_BITS / 4 different lines more lines are suspected in vain.

Defined cases: null and empty texts have one empty line, which stays; every row counts as a document, also one that
repeats a doc_id; a key's last holder is the largest doc_id, null counting as smallest; several rows with that doc_id
all keep it; very long texts and lines are hashed piece by piece and whole; an empty table gives no rows; only doc_id
and text are read, so no further column clashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table
from .textlines import Lines, lines

FILTER_BITS = 1 << 28
SEGMENT_BITS = 1 << 18
BROADCAST_BYTES = 32 << 20


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64(bits - 1)
    return np.stack([(hashes >> np.uint64(shift)) & mask for shift in (0, 31)]).astype(np.int64)


def _long(block: Lines, points: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of long lines, the first of each key in each text."""
    at = np.flatnonzero(block.points >= points)
    if len(at):
        order = np.lexsort((block.hash[at], block.text[at]))
        h, t = block.hash[at][order], block.text[at][order]
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        at = at[order][new]
    return at, block.hash[at]


def _fill(batches: Iterator[pa.RecordBatch], points: int, bits: int) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for batch in batches:
        for block in lines(batch.column(0)):
            _, hashes = _long(block, points)
            hashes, counts = np.unique(hashes, return_counts=True)
            at = _bits(hashes, bits)
            place, mask = at >> 3, (1 << (7 - (at & 7))).astype(np.uint8)
            again = (counts > 1) | (once[place] & mask).astype(bool).all(axis=0)
            np.bitwise_or.at(twice, place[:, again], mask[:, again])
            np.bitwise_or.at(once, place, mask)
    step = min(SEGMENT_BITS, bits) // 8
    full = np.flatnonzero(once.reshape(-1, step).any(axis=1)).tolist()
    for i in range(0, len(full), 64):
        a = full[i : i + 64]
        b, c = ([zlib.compress(x[j * step : (j + 1) * step].tobytes(), 1) for j in a] for x in (once, twice))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names=["segment", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if i not in held:
                held[i] = [a.copy(), b.copy()]
            else:
                held[i][1] |= b | (held[i][0] & a)
                held[i][0] |= a
    for i, (_, b) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], names=["segment", "twice"])


def filter_bits(texts: DataFrame, points: int) -> int:
    """A power of two: four bits for each line of so many code points that the texts have room for, within bounds."""
    room = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (points + 1)
    return min(FILTER_BITS, max(SEGMENT_BITS, 1 << (4 * room).bit_length()))


def seen_twice(texts: DataFrame, points: int = 40, bits: int | None = None) -> np.ndarray:
    """The filter of keys in two texts or more, as packed bits."""
    bits = bits or filter_bits(texts, points)
    parts = texts.mapInArrow(lambda it: _fill(it, points, bits), "segment int, once binary, twice binary")
    n = max(2, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = parts.repartition(n, "segment").mapInArrow(_merge, "segment int, twice binary")
    step = min(SEGMENT_BITS, bits) // 8
    packed = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        packed[r.segment * step : (r.segment + 1) * step] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return packed


def _test(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bits(hashes, len(packed) * 8)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def suspects(docs: DataFrame, points: int = 40, bits: int | None = None) -> DataFrame:
    """doc_id and key of every long line that may stand in several texts, once for each text."""
    twice = docs.sparkSession.sparkContext.broadcast(seen_twice(docs.select("text"), points, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in lines(batch.column(1)):
                at, hashes = _long(block, points)
                at = at[_test(twice.value, hashes)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(block.at + block.text[at])), pa.array([block.key(i).decode() for i in at], pa.string())], names=["doc_id", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key string")


def repeated_keys(docs: DataFrame, points: int = 40, documents: int = 5, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The suspected lines, and key, last (the doc_id that keeps it) of keys in at least so many documents."""
    found = cut(suspects(docs, points, bits))
    counted = found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= documents)
    return found, cut(counted.select("key", "last"))


class _Repeats:
    """Keys by hash, with the doc_id that keeps each."""

    def __init__(self, keys: list[str], last: list[int | None]):
        blocks = list(lines(pa.array(keys, pa.string())))
        self.keys = [k.encode() for k in keys]
        hashes = np.concatenate([b.hash for b in blocks]) if keys else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.last = last

    def dropped(self, block: Lines, ids: list[int | None]) -> np.ndarray:
        low, high = np.searchsorted(self.hashes, block.hash), np.searchsorted(self.hashes, block.hash, "right")
        drop = np.zeros(len(block.hash), bool)
        for i in np.flatnonzero(high > low):
            for j in self.order[low[i] : high[i]]:
                if self.keys[j] == block.key(i):
                    drop[i] = self.last[j] != ids[block.at + int(block.text[i])]
        return drop


def _kept(block: Lines, drop: np.ndarray) -> Iterator[bytes]:
    n = np.bincount(block.text, minlength=block.texts)
    gone = np.bincount(block.text[drop], minlength=block.texts)
    first = np.concatenate(([0], np.cumsum(n)))
    for t in range(block.texts):
        if not gone[t]:
            yield block.data[block.start[first[t]] : block.end[first[t + 1] - 1]].tobytes()
        else:
            yield b"\n".join(block.data[block.start[i] : block.end[i]].tobytes() for i in range(first[t], first[t + 1]) if not drop[i])


def _apply(batch: pa.RecordBatch, repeats: _Repeats) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    ids = batch.column(0).to_pylist()
    for block in lines(batch.column(1)):
        drop = repeats.dropped(block, ids) if len(repeats.keys) else np.zeros(len(block.hash), bool)
        yield block.at, np.bincount(block.text, minlength=block.texts), np.bincount(block.text[drop], minlength=block.texts), list(_kept(block, drop))


OUT = "doc_id long, n_lines long, n_dropped long, kept_text string"


def _rows(batch: pa.RecordBatch, repeats: _Repeats, digest: bool) -> Iterator[pa.RecordBatch]:
    for at, n, gone, kept in _apply(batch, repeats):
        last = pa.array([hashlib.sha256(x).hexdigest() for x in kept] if digest else [x.decode() for x in kept], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), last], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, points: int = 40, documents: int = 5, bits: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, digest: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text (or its SHA-256 if digest) of every row of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, repeated = repeated_keys(docs, points, documents, bits)
    size = repeated.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        rows = repeated.collect()
        known = docs.sparkSession.sparkContext.broadcast(_Repeats([r.key for r in rows], [r["last"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _rows(batch, known.value, digest)

        return docs.mapInArrow(run, OUT)
    lost = found.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("key").alias("lost"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, keys in enumerate(batch.column(2).to_pylist()):
                yield from _rows(batch.slice(i, 1), _Repeats(keys or [], [object()] * len(keys or [])), digest)

    return docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "lost").mapInArrow(run_joined, OUT)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept_text", "kept_sha256")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line,
    unnest(list_transform(ls, lambda x: translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS key FROM d),
k AS (SELECT key, max(doc_id) AS last, true AS repeated FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
x AS (SELECT l.*, coalesce(repeated, false) AND last IS DISTINCT FROM l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY r, doc_id
"""
