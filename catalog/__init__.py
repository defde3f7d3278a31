"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog.base import Query


def all_queries() -> list[Query]:
    from catalog import accounting, bodies, detection, redaction, registry, streams

    out = [*redaction.QUERIES, *bodies.QUERIES, *detection.QUERIES, *registry.QUERIES, *accounting.QUERIES, *streams.QUERIES]
    names = [q.name for q in out]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"query names used twice: {sorted(twice)}")
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalog import redaction

    return redaction.FLAGSHIP.call(spark, sf_dir)
