"""Structured Streaming: the same annotation on streams, numbers that run on across batches, windows over events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.running import running_ids
from ..operators.segment import annotated
from ..session import shared_dir


def text_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def annotate_stream(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences of a stream of documents. Rows are mapped alone, so a stream and a batch give the same."""
    return annotated(docs, key=key)


def numbered(stream: DataFrame, order: list[str], name: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each batch with a running number; a batch starts after what earlier batches wrote.

    Batches are written in folders of their own, so one that is run again replaces what it wrote and counts nothing twice.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # each batch leaves the number that the next one starts with: one row a batch is read, not what was written
        totals = spark.createDataFrame([], "batch_id long, upto long")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}-totals")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            totals = spark.read.schema("batch_id long, upto long").parquet(f"{out}-totals/*")
        last = totals.where(F.col("batch_id") < batch_id).agg(F.max_by("upto", "batch_id")).first()[0]
        own = running_ids(batch, order, name, last or 0)
        own.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        upto = (last or 0) + spark.read.parquet(f"{out}/batch={batch_id}").count()
        spark.createDataFrame([(batch_id, upto)], "batch_id long, upto long").coalesce(1).write.mode("overwrite").parquet(f"{out}-totals/{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_time(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with a watermark; times without zone count as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = event_time(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = event_time(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def to_the_end(aggregated: DataFrame) -> DataFrame:
    """What an aggregating stream has when its source is read to the end, written to the shared folder batch by batch."""
    spark = aggregated.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out-{batch_id}")
        last[:] = [batch_id]

    aggregated.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out-{last[0]}") if last else spark.createDataFrame([], aggregated.schema)


def each_batch(stream: DataFrame, f: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """f on every batch, each written in a folder of its own: a batch that is run again replaces what it wrote."""
    return stream.writeStream.foreachBatch(lambda b, i: f(b).write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
