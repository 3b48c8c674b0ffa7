"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its words (A-Z in lower case) weighted by how often they stand in it. For each sample k a term draws
r and c from Gamma(2, 1) and b from [0, 1), all from hashes of (term, k); with t = floor(ln(weight) / r + b) its rank is
ln(c) - r * (t - b) - r, and the term of the least rank is sampled together with t. Two texts draw the same sample with a
probability that is the generalised Jaccard similarity of their weighted terms.

Defined cases: a null text is an empty one; a text without words has an empty fingerprint, which is like another empty
one (1) and unlike all others (0); a null doc_id comes first in order; of rows with equal doc_id the one with the least
text hash is what the document before them sees as its next; a table of one document is its own next; an empty table
gives no rows; very long texts are counted whole, their terms row by row; only doc_id and text are read, so no further
column clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, next_keys, table

SAMPLES = 32
#: Samples drawn for each row of a pass: few enough for the compiled code of a pass to stay small.
GROUP = 8
WHITE = r"[\x20\x09-\x0D]+"
#: Added to the ranks of terms that a text lacks; above every rank.
_EMPTY = 1 << 61
_NULL_ID = -(1 << 63)


def _samples(term: Column, k: Column, lnw: list[Column], absent: list[Column]) -> list[Column]:
    """For each weight: the rank of a term's k-th sample over 32 bits that name the term and t."""
    a, b = F.xxhash64(term, k), F.xxhash64(k, term)
    part = lambda x, shift: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0x1FFFFFF)).cast("double") + 0.5) / float(1 << 25)
    r = -F.log(part(a, 39) * part(a, 14))
    lnc = F.log(-F.log(part(b, 39) * part(b, 14)))
    beta = (a.bitwiseAND(F.lit(0x3FFF)) * 0x4000 + b.bitwiseAND(F.lit(0x3FFF))).cast("double") / float(1 << 28)
    out = []
    for w, none in zip(lnw, absent, strict=True):
        t = F.floor(w / r + beta)
        rank = lnc - r * (t.cast("double") - beta) - r
        out.append(F.shiftleft(((rank + 96.0) * float(1 << 21)).cast("long"), 32) + F.shiftrightunsigned(F.xxhash64(term, t), 32)  + none)
    return out


def fingerprint_arrays(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each text column x, x_signature: array of 32-bit samples (null where the text has no words).

    If texts is already dealt by one of the keys, nothing is shuffled: a term's weights in all columns are counted
    where its row lies, then each term offers its samples to its row's minima.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(columns)])).alias("_x")
    words = texts.select(*keys, each).select(*keys, F.col("_x.i").alias("_i"), F.explode(F.split("_x.t", WHITE)).alias("_w")).where("_w <> ''")
    words = words.select(*keys, "_i", F.xxhash64(F.translate("_w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("_term"))
    counts = [F.sum((F.col("_i") == i).cast("int")).alias(f"_n{i}") for i in range(len(columns))]
    terms = words.groupBy(*keys, "_term").agg(*counts)
    n = [F.col(f"_n{i}") for i in range(len(columns))]
    terms = terms.select(*keys, "_term", *[F.log(F.greatest(x, F.lit(1)).cast("double")).alias(f"_l{i}") for i, x in enumerate(n)], *[F.when(x == 0, F.lit(_EMPTY)).otherwise(F.lit(0)).cast("long").alias(f"_a{i}") for i, x in enumerate(n)], F.explode(F.array(*[F.lit(g) for g in range(0, samples, GROUP)])).alias("_g"))
    lnw, absent = [F.col(f"_l{i}") for i in range(len(n))], [F.col(f"_a{i}") for i in range(len(n))]
    drawn = [(j, i, x) for j in range(GROUP) for i, x in enumerate(_samples(F.col("_term"), F.col("_g") + j, lnw, absent))]
    least = terms.groupBy(*keys, "_g").agg(*[F.min(x).alias(f"_s{i}_{j}") for j, i, x in drawn])
    arrays = [F.array(*[F.col(f"_s{i}_{j}") for j in range(GROUP)]).alias(f"_s{i}") for i in range(len(n))]
    packed = least.select(*keys, F.struct("_g", *arrays).alias("_part"))
    whole = packed.groupBy(*keys).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    out = []
    for i, c in enumerate(columns):
        flat = F.flatten(F.col(f"_parts._s{i}"))
        out.append(F.when(F.element_at(flat, 1) < _EMPTY, F.transform(flat, lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - (1 << 31)).cast("int"))).alias(f"{c}_signature"))
    return whole.select(*keys, *out)


def as_text(signature: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + (1 << 31))), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same.cast("double") / F.size(a))


def _keyed(docs: DataFrame) -> DataFrame:
    """_k (the doc_id, a null one as the least long) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_k"), F.coalesce("text", F.lit("")).alias("text"))


def _numbered(docs: DataFrame) -> DataFrame:
    """_k, text and _rn, the place among rows of that doc_id. Dealt by _k in an exchange that every branch of a plan has alike, so texts move once."""
    return _keyed(docs).repartition("_k").withColumn("_rn", F.row_number().over(Window.partitionBy("_k").orderBy(F.xxhash64("text"), "text")))


def _doc_id() -> Column:
    return F.when(F.col("_k") != _NULL_ID, F.col("_k")).alias("doc_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row of docs(doc_id, text)."""
    rows = _numbered(docs)
    marks = fingerprint_arrays(rows, ["_k", "_rn"], ["text"])
    return rows.join(marks, ["_k", "_rn"], "left").select(_doc_id(), F.char_length("text").cast("long").alias("n_chars"), as_text(F.col("text_signature")).alias("fingerprint"))


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document (see the contract of op8).

    Texts move once, to be dealt by doc_id, and with them the start of each next document. All that follows moves
    fingerprints.
    """
    n = F.char_length("text").cast("long")
    sizes = _keyed(docs).groupBy("_k").agg(F.max(n).alias("_longest"))
    follow = cut(next_keys(sizes, "_k", "_next").join(sizes, "_k"))
    rows = _numbered(docs)
    heads = rows.where("_rn = 1").select(F.col("_k").alias("_next"), F.col("text").alias("_head")).join(follow, "_next")
    heads = heads.select("_k", F.substring(F.col("_head"), F.lit(1), F.floor(F.col("_longest") / 4).cast("int")).alias("_head"))
    c = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - c).cast("int")), F.substring(F.col("_head"), F.lit(1), c))
    both = rows.join(heads, "_k").select("_k", "_rn", "text", edited.alias("edited"))
    meta = both.select("_k", "_rn", n.alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    marks = cut(meta.join(fingerprint_arrays(both, ["_k", "_rn"], ["text", "edited"]), ["_k", "_rn"], "left"))
    after = follow.select("_k", "_next").join(marks.where("_rn = 1").select(F.col("_k").alias("_next"), F.col("text_signature").alias("_after")), "_next").drop("_next")
    out = marks.join(after, "_k", "left")
    a, b, c = F.col("text_signature"), F.col("edited_signature"), F.col("_after")
    return out.select(_doc_id(), "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
