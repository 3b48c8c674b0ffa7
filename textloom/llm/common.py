"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, BATCH_ROWS, bounded_batches  # noqa: F401

#: ASCII white space as the contracts define it; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a local session (tests, a laptop) has none, a temporary one is set; a cluster without one is refused."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if conf := spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(conf)
    elif sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; what follows reads that copy and not df's lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one key that a join leaves in one task, and, of more, how many of a key's rows share a salt.
HOT_ROWS, SALT_ROWS = 256, 128
#: A key with a larger share of all rows than one in so many is salted: so many keys at most, whose salts are broadcast.
HOT_KEYS = 10_000


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, counted: DataFrame | None = None) -> DataFrame:
    """left joined with right by key, without a task that gets all rows of a hot key.

    A key that many rows of left have is dealt over salts by a hash of their column spread, and its rows of right (few:
    one as a rule) are repeated for each. In all, right grows by one row for every SALT_ROWS rows of left at most.
    counted, if given, has left's rows of each key as _n, or more.
    """
    if counted is None:
        counted = left.groupBy(key).agg(F.count("*").alias("_n"))
    hot = cut(counted.where(F.col("_n") >= HOT_ROWS).select(key, "_n"))
    many, total = hot.agg(F.count("*"), F.sum("_n")).first()
    if not many:
        return left.join(right, key)
    if many > HOT_KEYS:
        hot = hot.where(F.col("_n") >= total // HOT_KEYS)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / SALT_ROWS).cast("long").alias("_salts")))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def next_keys(keys: DataFrame, key: str, following: str) -> DataFrame:
    """Each distinct value of the column key (null among them, first) with the next larger one; the largest gets the smallest.

    Keys are dealt by range, each range looks for its successors alone, and only the first key of each range (one row
    a partition) meets in one task.
    """
    ranged = cut(keys.select(key).distinct().repartitionByRange(F.col(key).asc_nulls_first()).withColumn("_range", F.spark_partition_id()))
    firsts = ranged.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("has"), F.col(key).alias("value"))).alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_range", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("_after"))
    within = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first())
    led = ranged.select(key, "_range", F.lead(F.struct(F.lit(True).alias("has"), F.col(key).alias("value"))).over(within).alias("_led"))
    return led.join(F.broadcast(firsts), "_range").select(key, F.when(F.col("_led").isNotNull(), F.col("_led.value")).otherwise(F.col("_after.value")).alias(following))
