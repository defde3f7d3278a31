"""Restore inside a stream: tokens and residuals cut anywhere, dictionaries that grow, tool policies."""

import re

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.surrogates import Surrogates
from cloakwork.streaming import restore as SR

SUR = Surrogates("k")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "stream_id string, fragment string, seq long, kind string, text string, stop boolean, layer string"


def run(spark, tmp_path, rows, dictionary, policy="all", batches=3):
    """Rows through several micro-batches, in the order of seq."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    most = max(r[2] for r in rows) + 1
    for k in range(batches):
        part = [r for r in rows if r[2] * batches // most == k]
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(src)
    table = spark.createDataFrame(dictionary, "stream_id string, token string, value string, layer string")
    q = SR.restore_stream(stream, table, SUR, policy).writeStream.option("checkpointLocation", str(tmp_path / "cp")).option(
        "path", out).format("parquet").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = spark.read.schema(SR.OUT_SCHEMA).parquet(out).groupBy("stream_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"),
        F.sum("withheld").alias("withheld"), F.sum("residuals").alias("residuals"))
    return {r["stream_id"]: (r["text"], r["withheld"], r["residuals"]) for r in got.collect()}


def token_of(spark, value):
    return spark.range(1).select(SUR.mint_typed(F.lit(value), F.lit("x"), F.lit("secret")).alias("t")).first()["t"]


def test_tokens_and_residuals_cut_at_every_position(spark, tmp_path):
    known, lost = token_of(spark, "value"), token_of(spark, "nobody's")
    text = f"a {known} b {lost} c {lost[:-7]} d {lost}, {known}."
    debris = {m.group(0) for m in re.finditer(SUR.residual_pattern, text)} - {known}
    rows, dictionary = [], []
    for cut in range(1, len(text)):
        for seq, part in enumerate((text[:cut], text[cut:])):
            rows.append((f"s{cut}", "f", seq * 3, "text", part, seq == 1, None))
        dictionary.append((f"s{cut}", known, "value", "detected"))
    rows += [("tiny", "f", i, "text", c, i == len(text) - 1, None) for i, c in enumerate(text)]
    got = run(spark, tmp_path, rows, [*dictionary, ("tiny", known, "value", "detected")])
    want = text.replace(known, "value")
    assert len(got) == len(text) and set(got.values()) == {(want, 0, len(debris))}


@pytest.mark.parametrize("policy", SR.POLICIES)
def test_dictionaries_grow_and_tools_follow_the_policy(spark, tmp_path, policy):
    a, b = token_of(spark, 'say "a"'), token_of(spark, "b")
    args = '{"x":"' + a + '","y":"' + b + '"}'
    rows = [("s", "tool", 5, "tool", args[:20], False, None), ("s", "tool", 6, "tool", args[20:], True, None),
            ("s", b, 1, "entry", "b", False, "registry"), ("s", b, 2, "entry", "worse", False, "detected"),
            ("other", "f", 5, "text", f"{a} {b}", True, None)]
    got = run(spark, tmp_path, rows, [("s", a, 'say "a"', "detected")], policy)
    x, y = ("say \\\"a\\\"" if policy != "none" else a), ("b" if policy == "all" else b)
    assert got["s"] == ('{"x":"' + x + '","y":"' + y + '"}', {"all": 0, "detected": 1, "none": 2}[policy], 0)
    assert got["other"] == (f"{a} {b}", 0, 2)             # no stream restores what another one owns
