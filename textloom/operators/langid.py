"""A language baseline in plain relational steps: multinomial naive Bayes over character trigrams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, cut


def trigrams(text: Column) -> Column:
    """Every three neighbouring characters of a text in lower case, in time linear in its length."""
    low = F.lower(text)
    return F.concat(*[F.regexp_extract_all(F.substring(low, i, 1 << 30), F.lit("(?s)..."), F.lit(0)) for i in (1, 2, 3)])


def _grams(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.explode(trigrams(F.col("text"))).alias("gram"))


#: More languages than this are refused: each is a column of the model.
LANGUAGES = 512


@dataclass(frozen=True)
class TrigramModel:
    """table(gram, weights): a trigram's log-probability in every language; missing: the weights of a trigram that none holds."""

    table: DataFrame
    missing: tuple[tuple[str, float], ...]


def fit(docs: DataFrame) -> TrigramModel:
    """A model of docs(lang, text), with one count added to every trigram."""
    # counted once: the totals, the number of trigrams and the table read that copy
    counted = cut(_grams(docs.where("lang is not null"), "lang").groupBy("lang", "gram").agg(F.count("*").alias("n")))
    rows = counted.groupBy("lang").agg(F.sum("n").alias("total")).limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    size = counted.select("gram").distinct().count()
    totals = {r.lang: float(r.total + size) for r in sorted(rows)}
    by = counted.groupBy("gram").pivot("lang", list(totals)).agg(F.first("n"))
    weights = [F.struct(F.lit(x).alias("lang"), F.log((F.coalesce(F.col(f"`{x}`"), F.lit(0)) + 1) / F.lit(t)).alias("w")) for x, t in totals.items()]
    return TrigramModel(cut(by.select("gram", F.array(*weights).alias("weights"))), tuple((x, -math.log(t)) for x, t in totals.items()))


#: Trigrams and weights of a model that is broadcast: 32 MB.
CELLS = 1 << 22
#: Characters that a worker scores at once.
CHARS = 1 << 17


def _codes(text: str) -> np.ndarray:
    """A number for each of a text's trigrams, by the code points."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _scored(docs: DataFrame, model: TrigramModel) -> DataFrame:
    """doc_id and scores of every text that has a trigram, a score a language in the model's order."""
    held = model.table.select("gram", F.col("weights.w").alias("w")).toArrow()
    missing = np.array([w for _, w in model.missing])
    grams = np.frombuffer("".join(held.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3)
    keys = (grams[:, 0] << 42) | (grams[:, 1] << 21) | grams[:, 2]
    order = np.argsort(keys)
    # the last row is that of trigrams that none holds
    table = np.vstack([held.column("w").combine_chunks().flatten().to_numpy().reshape(-1, len(missing))[order], missing])
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], table))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            rows, scores = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text is None or len(text) < 3:
                    continue
                total = np.zeros(table.shape[1])
                for at in range(0, len(text) - 2, CHARS):
                    codes = _codes(text[at : at + CHARS + 2])
                    place = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                    place[keys[place] != codes] = len(keys)
                    total += table[place].sum(axis=0)
                rows.append(i)
                scores.append(total.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["doc_id", "scores"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.lower("text")).mapInArrow(run, f"doc_id {kind}, scores array<double>")


def identify(docs: DataFrame, model: TrigramModel) -> DataFrame:
    """doc_id and lang_pred, the language of the best score (three digits), the first by name on ties.

    A model of at most CELLS weights is broadcast and texts are scored where they lie; a larger one is joined.
    """
    n = len(model.missing)
    if n and model.table.count() * (n + 1) <= CELLS:
        names = F.array(*[F.lit(x) for x, _ in model.missing])
        sums = F.array(*[F.round(F.sum(F.get("scores", F.lit(i))), 3) for i in range(n)])
        best = _scored(docs, model).groupBy("doc_id").agg(sums.alias("s"))
        # the names are in order, and the first of equal scores is taken
        return best.select("doc_id", F.get(names, (F.array_position("s", F.array_max("s")) - 1).cast("int")).alias("lang_pred"))
    per = _grams(docs, "doc_id").groupBy("doc_id", "gram").agg(F.count("*").alias("k"))
    none = F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(w).alias("w")) for x, w in model.missing])
    joined = per.join(model.table, "gram", "left").select("doc_id", "k", F.explode(F.coalesce("weights", none)).alias("x"))
    scores = joined.groupBy("doc_id", F.col("x.lang").alias("lang")).agg(F.round(F.sum(F.col("k") * F.col("x.w")), 3).alias("score"))
    return scores.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "lang")).alias("m")).select("doc_id", F.col("m.lang").alias("lang_pred"))
