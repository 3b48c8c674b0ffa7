"""As-of join: each row with the last row of another table at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """left with the values of right's last row with equal keys and right.at <= left.at; null where there is none.

    Both tables are laid together and a window carries the last right row forward: one shuffle by key, no range join.
    """
    own = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    other = right.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("_last", F.last("_value", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])
