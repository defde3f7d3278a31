"""Helpers the corpus operators share: words, bindings inside expressions, written stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
LAST_ID = (1 << 63) - 1


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(id_col: str) -> Column:
    """Ids as join keys: a null id counts as the largest one."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; one of our own only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "stage", drop_shuffles: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives lost executors.

    ``drop_shuffles``: the shuffle files of the write go at its end, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP, None)
    if drop_shuffles:
        spark.conf.set(_DROP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_DROP) if before is None else spark.conf.set(_DROP, before)
    return spark.read.schema(df.schema).parquet(path)
