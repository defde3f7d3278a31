"""Session settings the library relies on, and the durable lineage cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins and splits skewed partitions at run time; the
# runtime bloom filter keeps texts without candidates out of text shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # call-site capture costs a JVM round trip per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`SETTINGS` to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "cloakwork", **conf: str) -> SparkSession:
    """Session for local runs and tests; on a cluster pass the submitted session instead."""
    builder = configure(SparkSession.builder.appName(app))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder (survives executor loss).

    The folder is the one the session names in ``spark.checkpoint.dir``; only when it
    names none (tests) is a temporary one set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
