"""Joins and folds over spans: interval anti join, best cover, containment, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_overlap(spans: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The spans that overlap none of others within equal keys."""
    a, b = spans.alias("a"), others.select(*keys, "start", "end").alias("b")
    return a.join(b, _keys("a", "b", keys) & _crossing("a", "b"), "left_anti")


def _keys(a: str, b: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return cond


def _crossing(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def best_cover(spans: DataFrame, covers: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """spans with the value of the cover that overlaps most, the first on ties; null where none does."""
    a, b = spans.alias("a"), covers.alias("b")
    width = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    joined = a.join(b, _keys("a", "b", keys) & _crossing("a", "b"), "left")
    named = [F.col(f"a.{c}").alias(c) for c in spans.columns]
    best = joined.select(*named, F.struct((-width).alias("w"), F.col("b.start").alias("s"), F.col(f"b.{value}").alias("v")).alias("_c"))
    return best.groupBy(*spans.columns).agg(F.min(F.when(F.col("_c.w").isNotNull(), F.col("_c"))).alias("_m")).select(*spans.columns, F.col("_m.v").alias(value))


def covered(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """points(at) joined with the half-open spans that hold them."""
    a, b = points.alias("a"), spans.alias("b")
    rest = [F.col(f"b.{c}").alias(c) for c in spans.columns if c not in keys]
    cond = _keys("a", "b", keys) & (F.col(f"a.{at}") >= F.col("b.start")) & (F.col(f"a.{at}") < F.col("b.end"))
    return a.join(b, cond).select("a.*", *rest)


def islands(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spans with the number of the island (run of overlapping spans) each belongs to, from 0 within keys."""
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return spans.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_fresh")
