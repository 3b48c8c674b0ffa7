"""Numbers that run on over a whole table, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with name: the sum of value over all rows before, in the given order.

    Rows are dealt by range and summed there; each range is shifted by the sums of those before it, of which one row a
    partition meets in one task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(shifts), "_range").withColumn(name, (F.col("_before") + own).cast("long")).drop("_range", "_before")


def running_ids(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """df with name: start, start + 1, ... in the given order."""
    return running_sum(df.withColumn("_one", F.lit(1)), order, "_one", name).withColumn(name, F.col(name) + start).drop("_one")
