"""Language ID: multinomial naive Bayes over hashed character n-grams.

Runs of one to three code points (letters in lower case, anything else as a blank) are hashed into BUCKETS; the matrix
of log-probabilities, languages by buckets, is broadcast, and batches of texts are scored with numpy by gathering its
columns and summing them text by text. Classes have equal prior weight.

The model is fitted on a bounded sample: about TRAIN_ROWS rows of each language, by a hash of doc_id, among rows whose
crc32(doc_id) mod 5 is not 0. Scoring reads every whole text.

Defined cases: `und` with score 0 for a null text, a text without letters, or where no row is labelled; a null doc_id
counts as held out; ties go to the first language in order; rows are scored alone, so repeated rows score alike; a very
long text is scored whole, in a block of its own; an empty table gives no rows; identify() reads doc_id and text only,
with_language() carries the rest of a row as one value, so no further column clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

BUCKETS = 1 << 16
TRAIN_ROWS = 2000
#: More languages than this are refused: the matrix, 0.25 MB a language, is held by the driver and by every worker (32 MB).
LANGUAGES = 128
SMOOTHING = 0.5
#: Code points scored together; a longer text makes a block of its own.
BLOCK = 1 << 18

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    block: list[str] = []
    size = at = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        if block and size + len(t) > BLOCK:
            yield at, block
            block, size, at = [], 0, i
        block.append(t)
        size += len(t)
    if block:
        yield at, block


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every n-gram of the texts, the text each belongs to, and which texts have letters."""
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes) - 1
    is_letter = letters()[points]
    symbol = np.where(is_letter, points, 32).astype(np.uint64)
    ids, owners = [], []
    inside = np.ones(len(points), bool)
    inside[ends] = False
    total = np.zeros(len(points), np.uint64)
    some = np.zeros(len(points), bool)
    for n in range(3):
        m = len(points) - n
        if m <= 0:
            break
        total = total[:m] * np.uint64(0x9E3779B97F4A7C15) + (symbol[n:] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        inside = inside[:m] & (True if n == 0 else ~np.isin(np.arange(n, len(points)), ends, assume_unique=True))
        some = some[:m] | is_letter[n:]
        mixed = total ^ (total >> np.uint64(29))
        mixed = mixed * np.uint64(0x94D049BB133111EB)
        take = inside & some
        ids.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS))[take].astype(np.int32))
        owners.append(owner[:m][take])
    has = np.bincount(owner[is_letter], minlength=len(texts)) > 0
    return np.concatenate(ids), np.concatenate(owners), has


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for _, block in _blocks(texts):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(grams(block)[0], minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each language's counts as one row of bytes; all rows of a language are in one partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        for i, lang in enumerate(names.dictionary.to_pylist()):
            own = names.indices.to_numpy() == i
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))[batch.column(1).to_numpy()[own]] += batch.column(2).to_numpy()[own]
    for lang, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([n.tobytes()], pa.binary())], names=["lang", "counts"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _log_prob(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS)).astype(np.float32)


class LanguageModel:
    def __init__(self, languages: list[str], log_prob: np.ndarray):
        self.languages, self.log_prob = languages, log_prob

    @classmethod
    def fit(cls, docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
        bounded_batches(docs.sparkSession)
        labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
        sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
        if len(sizes) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        shares = docs.sparkSession.createDataFrame([(r.lang, int(rows / r.n * (1 << 30))) for r in sizes], "lang string, share long")
        draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30))
        # the sample is drawn where the rows lie: only counts are shuffled
        sample = labelled.select("lang", "text", draw.alias("draw")).join(F.broadcast(shares), "lang").where("draw < share").select("lang", "text")
        counted = sample.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        packed = counted.repartition("lang").mapInArrow(_packed, "lang string, counts binary")
        # one language at a time passes through the driver
        rows_of = {r.lang: _log_prob(np.frombuffer(r.counts, np.int64)) for r in packed.toLocalIterator()}
        languages = sorted(rows_of)
        return cls(languages, np.stack([rows_of[x] for x in languages]) if languages else np.zeros((0, BUCKETS), np.float32))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores = []
        for _, block in _blocks(texts):
            ids, owner, has = grams(block)
            best = np.zeros(len(block))
            pick = np.full(len(block), -1)
            if self.languages and len(ids):
                # n-grams of one length lie together and in the texts' order
                total = np.stack([np.bincount(owner, row[ids], minlength=len(block)) for row in self.log_prob])
                pick = np.where(has, total.argmax(axis=0), -1)
                share = np.exp(total - total.max(axis=0))
                best = np.where(has, 1.0 / share.sum(axis=0), 0.0)
            names += [self.languages[i] if i >= 0 else "und" for i in pick]
            scores.append(best)
        return names, np.concatenate(scores) if scores else np.zeros(0)


def predictor(docs: DataFrame, model: LanguageModel):
    """A function of the text column: struct<lang_pred, score>."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = shared.value.score(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    predict = predictor(docs, model)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs whose language is found; those without one (`und`) go."""
    columns = docs.columns
    predict = predictor(docs, model)
    return docs.select(F.struct("*").alias("_row"), predict(F.col("text")).alias("_p")).where("_p.lang_pred <> 'und'").select("_row.*").select(*columns)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, LanguageModel.fit(docs.select("doc_id", "lang", "text")))
