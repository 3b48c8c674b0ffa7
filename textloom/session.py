"""Sessions with the settings the engine is written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session: UTC, Arrow, adaptive plans. Partition counts stay with the cluster unless given in conf."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in {**fixed, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session that has none (tests, a laptop) gets a temporary one; a cluster without one is refused."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows, and bytes, of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Has the session pass rows to Python workers in batches of at most BATCH_ROWS and about BATCH_BYTES; smaller settings stay.

    The defaults, 10,000 rows and 64 MB, are held several times over on both sides of each running task.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


#: Inputs smaller than this may lie in fewer pieces than there are cores.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its input is small (one file, one row group); a large input stays as it is read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_INPUT else df


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; what follows reads that copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
