"""Embeddings and search: hashed term vectors, pooling, exact top-k by cosine in blocks of queries."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.unicode import bounded_udf
from ..session import BATCH_ROWS, bounded_batches

#: Queries searched in one pass over the rows, and the bytes of their vectors: a block of them is broadcast.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Scores that a worker holds at once.
SCORES = 1 << 20
#: Places of a term in a hashed vector. With one of 4,096, two terms in 8,192 share it, and texts that differ in them
#: alone have one vector; with four, one pair in some 10^14.
PLACES = 4


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision, in the JVM."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = add(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(add(F.transform(x, lambda y: y.cast("double") * y.cast("double"))))
    return dot / (norm(a) * norm(b))


def l2_normalized(v: Column) -> Column:
    n = F.greatest(F.sqrt(F.aggregate(F.transform(v, lambda y: y.cast("double") * y.cast("double")), F.lit(0.0), lambda s, y: s + y)), F.lit(1e-12))
    return F.transform(v, lambda y: y.cast("double") / n)


def pooled(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean vector of each group, of length one."""
    dims = df.select(*keys, F.posexplode(vector).alias("_d", "_x")).groupBy(*keys, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    rows = dims.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_v"))
    return rows.select(*keys, l2_normalized(F.col("_v._m")).alias(vector))


def hashed_terms(size: int = 256, prefix: str = ""):
    """An Arrow UDF from texts to hashed term-frequency vectors of length one, each term at PLACES places; prefix marks queries or passages."""

    def embed(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            v = np.zeros(size, np.float64)
            for w in (prefix + (t or "")).lower().split():
                for h in struct.unpack(f"<{PLACES}I", hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=4 * PLACES).digest()):
                    v[h % size] += 1 if h & 0x80000000 else -1
            out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
        return pa.array(out, pa.list_(pa.float32()))

    return bounded_udf(embed, "array<float>")


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids: list = []
    vectors: list = []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) >= min(BLOCK, max(1, BLOCK_BYTES // (8 * max(1, len(r[1]))))):
            yield ids, np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, np.float64)


class _Best:
    """The k best rows so far of each of n queries: the highest score, then the least row id."""

    def __init__(self, n: int, k: int):
        self.k = k
        #: query, row id and score, by query and in order
        self.q, self.ids, self.s = np.empty(0, np.int64), None, np.empty(0)
        #: the score and row id that a query's next row must beat; none yet: below every score
        self.least, self.last = np.full(n, -np.inf), None

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[query, row] of rows with these ids."""
        n = min(self.k, scores.shape[1])
        floor = self.least
        if np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n])
        take = scores >= floor[:, None]
        if self.last is not None:
            # a row that ties with the last of k counts only if its id is less
            take &= (scores > self.least[:, None]) | (ids[None, :] < self.last[:, None]) | np.isneginf(self.least)[:, None]
        q, r = np.nonzero(take)
        if not len(q):
            return
        s, found = np.concatenate([self.s, scores[q, r]]), ids[r] if self.ids is None else np.concatenate([self.ids, ids[r]])
        q = np.concatenate([self.q, q])
        order = np.lexsort((found, -s, q))
        q, s, found = q[order], s[order], found[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.s, self.ids = q[keep], s[keep], found[keep]
        full = place[keep] == self.k - 1
        # a wider type where the ids are text
        self.last = np.zeros(len(self.least), self.ids.dtype) if self.last is None else self.last.astype(np.promote_types(self.last.dtype, self.ids.dtype))
        self.least[self.q[full]], self.last[self.q[full]] = self.s[full], self.ids[full]

    def parts(self, size: int) -> Iterator[tuple[list, list, np.ndarray]]:
        for at in range(0, len(self.q), size):
            yield self.q[at : at + size].tolist(), self.ids[at : at + size].tolist(), self.s[at : at + size]


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query id, row id and score (six digits) of each query's k nearest rows, ties by row id.

    queries(id, vector) pass in blocks; a task scores its rows in pieces of SCORES scores, keeps each query's k best so
    far and offers these at its end, so what is shuffled is k rows a task and query.
    """
    (q_id, _), (r_id, r_vec) = queries.columns, rows.columns
    q_arrow, r_arrow = (to_arrow_type(x.schema[0].dataType) for x in (queries, rows))
    q_type, r_type = queries.schema[0].dataType.simpleString(), rows.schema[0].dataType.simpleString()

    def one(ids: list, matrix: np.ndarray) -> DataFrame:
        unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = rows.sparkSession.sparkContext.broadcast((ids, unit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_ids, unit = shared.value
            best = _Best(len(unit), k)
            step = max(1, SCORES // len(unit))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    v = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    best.offer(np.round(unit @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, 6), np.array(part.column(0).to_pylist()))
            for qs, found, scores in best.parts(BATCH_ROWS * 8):
                yield pa.RecordBatch.from_arrays([pa.array([own_ids[i] for i in qs], q_arrow), pa.array(found, r_arrow), pa.array(scores)], names=[q_id, r_id, "score"])

        return rows.select(r_id, r_vec).mapInArrow(run, f"{q_id} {q_type}, {r_id} {r_type}, score double")

    bounded_batches(rows.sparkSession)
    parts = [one(*b) for b in _blocks(queries)]
    if not parts:
        return rows.sparkSession.createDataFrame([], f"{q_id} {q_type}, {r_id} {r_type}, score double")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("_place", F.row_number().over(Window.partitionBy(q_id).orderBy(F.desc("score"), r_id)))
    return ranked.where(F.col("_place") <= k).drop("_place")


def having(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks whose entities hold name."""
    return chunks.where(F.array_contains("entities", name))


def most_named(chunks: DataFrame, k: int = 12) -> DataFrame:
    """The entities that most chunks name, then by name: a report of k rows."""
    return chunks.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(k)


def store(rows: DataFrame, path: str, vector: Column, mode: str = "errorifexists") -> None:
    """Writes rows with their embeddings (vector, for instance hashed_terms()(content)) as Parquet at path: the collection that search_store reads."""
    rows.withColumn("embedding", vector).write.mode(mode).parquet(path)


def search_store(queries: DataFrame, path: str, row_id: str, k: int) -> DataFrame:
    """Each of queries(id, vector)'s k nearest rows of a stored collection, with the rows' own columns."""
    kept = queries.sparkSession.read.parquet(path)
    found = search(queries, kept.select(row_id, "embedding"), k)
    return found.join(kept.drop("embedding"), row_id)
