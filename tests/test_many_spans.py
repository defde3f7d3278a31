"""Scan and splice of columns with many spans a text: the same spans and texts as the row-wise ones, whatever the batch."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from cloakwork.operators import spans as SP

TEXTS = ["", None, "xyz", "a", "aé日😀a", "é" * 70 + "a" * 70, "ab\x01a", "bcd a", "abé" * 500]


def test_scan_and_splice_many(spark, monkeypatch):
    assert SP._row_slices(SP._before(SP.np.array([400_000] * 4))[1:]) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)
    safe = SP.mark_safe(F.col("t"))
    mark = lambda s: F.concat(F.lit("<é"), s.value, F.lit(">"))
    rows = df.select("i", "t", SP.scan(safe, "([aé])").alias("one"), SP.scan_many(safe, "([aé])").alias("many"))
    rows = rows.withColumn("backward", F.reverse("many"))
    got = rows.select("t", "one", "many", *[
        SP.splice_many(F.col("t"), F.col(c), mark).alias(f"s_{c}") for c in ("many", "backward")]).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["one"] == r["many"]
        want = None if r["t"] is None else re.sub("([aé])", r"<é\1>", r["t"])
        assert r["s_many"] == want and r["s_backward"] == want


def test_cost_of_a_span_does_not_grow_with_the_text(spark):
    import time

    def took(n, k):
        df = spark.createDataFrame([("ab" * n,)] * k, "t string").coalesce(1)
        s = SP.scan_many(F.col("t"), "(a)")
        df = df.select("t", s.alias("s")).select(SP.splice_many(F.col("t"), F.col("s"), lambda x: F.lit("_")).alias("o"))
        t0 = time.time()
        assert df.first()["o"] == "_b" * n
        return time.time() - t0

    took(10, 1)
    # 300,000 spans in one text; the array functions looked at 1,200 sums for each of them
    assert took(300_000, 1) < 20


def test_spans_never_stand_in_memory_for_a_whole_batch(spark):
    marked = pa.array(["\x01a\x01" * 1000] * 1000)
    done = list(SP._located.func(iter([marked.slice(0, 600), marked.slice(600), marked.slice(0, 0)])))
    # a million spans of 13 bytes came back in one piece for each batch
    assert sum(len(x) for x in done) == 1000 and max(x.nbytes for x in done) < 6_000_000
    df = spark.createDataFrame([("ab",)], "t string").select("t", SP.scan_many(F.col("t"), "(a)").alias("s"))
    df = df.select(SP.splice_many(F.col("t"), F.col("s"), lambda x: F.lit("_")).alias("o"))
    # spans and tokens travel to the splice a few rows at a time, not as Arrow batches of 10,000 texts
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("BatchEvalPython") == 1


def test_splice_row_by_row():
    cases = [((None, [0], [1], ["x"]), None), (("ab", None, None, None), None), (("ab", [], [], []), "ab"),
             (("日😀b", [1, 2], [2, 3], ["<", ">"]), "日<>"), (("abc", [2, 0], [3, 1], ["y", "x"]), "xby"),
             (("abc", [1, 5], [2, 9], ["x", None]), "axc"), (("abcd", [0, 1], [3, 4], ["x", "y"]), "xy")]
    for given, want in cases:
        assert SP._spliced(*given) == want
