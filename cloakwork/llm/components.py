"""Connected components of a graph given as edges, by joins that halve what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of edges ``a``, ``b`` (long).

    Large-star and small-star steps by turns until the edges are stars.  Each step is one shuffle of
    the edges, with minima pre-aggregated, and is written before the next; self loops are ignored.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # large star: larger neighbours of a node point to its smallest neighbour
        turned = both(now)
        least = turned.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = turned.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label")))
