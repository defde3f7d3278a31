"""Body rules that single queries do not show: numbers in the gate, content view, depth, masked paths."""

import json

from pyspark.sql import functions as F

from cloakwork.functions.surrogates import Surrogates
from cloakwork.functions.text import let
from cloakwork.operators import detect as D
from cloakwork.operators import registry as R
from cloakwork.operators.paths import preserved
from cloakwork.plans import redact as RD
from cloakwork.sources import readers as S


def bodies(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, body string")


def forms(spark, *values):
    return spark.createDataFrame([(v, f"n{i}") for i, v in enumerate(values)], "value string, name string")


def test_gate_sees_registered_numbers(spark):
    r = RD.Redactor(Surrogates("k"), [], forms(spark, "12345678901", "other-value"))
    df = bodies(spark, '{"n":12345678901,"t":"hello"}', '{"n":123456789012}', '{"t":"say other-value"}').withColumn(
        "redacted", F.col("body")).withColumn("known", F.array().cast("array<struct<value:string,token_bound:boolean>>"))
    got = {x["id"]: x["leaks"] for x in r.gate(df, ["id"], json_body=True).collect()}
    assert got == {0: ["12345678901"], 1: [], 2: ["other-value"]}


def test_personal_data_is_looked_for_in_contents_only(spark):
    r = RD.Redactor(Surrogates("k"), D.PII_RULES)
    out = r.redact_bodies(bodies(spark, '{"user@corp.test":"x"}', '{"to" : "user@corp.test"}'), ["id"])
    got = {x["id"]: x["redacted"] for x in out.collect()}
    assert got[0] == '{"user@corp.test":"x"}' and "user@corp.test" not in got[1] and got[1].startswith('{"to" : "')


def test_leaves_of_any_depth(spark):
    value = {"leaf": "bottom"}
    deep = [json.dumps(value)]
    for i in range(24):
        value = {"a": value} if i % 2 else [value]
        deep.append(json.dumps(value))
    rows = S.flatten_leaves(bodies(spark, *deep, "not json", '{"a.b":"c","it\'s":{"x":"y"}}'), ["id"]).collect()
    found = {(x["id"], x["text"]) for x in rows if x["kind"] == "value"}
    assert found == {(i, "bottom") for i in range(25)} | {(26, "c"), (26, "y")}
    assert {x["path"] for x in rows if x["id"] == 26} == {"$['a.b']", "$['it\\'s']", "$['it\\'s'].x"}
    assert [x["text"] for x in rows if x["kind"] == "raw"] == ["not json"]


def test_inspected_paths_hide_values_and_odd_keys(spark):
    body = json.dumps({"acme-secret.x": {"ok": "acme-secret"}, "odd key!": "acme-secret", "plain": ["acme-secret"], "acme-secret": "no"})
    out = R.inspect_paths(S.flatten_leaves(bodies(spark, body), ["id"]), forms(spark, "acme-secret"), ["id"]).collect()
    paths = sorted(x["path"] for x in out)
    assert not any("acme" in p or "odd" in p for p in paths)
    assert "$.plain[0]" in paths and len({p for p in paths if "<key#" in p}) == len([p for p in paths if "<key#" in p]) == 4


def test_path_rule_is_linear(spark):
    import time

    def seconds(n):
        df = spark.range(1).select(F.concat(F.lit("x" * n), F.lit("/a build-1 b")).alias("t"))
        start = time.perf_counter()
        df.select(let(F.instr("t", "build-1") - 1, lambda s: preserved(F.col("t"), s, s + 7, F.lit("build-1")))).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(1_000_000) < 10
