"""Secret-ish keys and their values meet without a join, and literals of any form are read."""

from pyspark.sql import functions as F

from cloakwork.operators import bodies as B
from cloakwork.operators import detect as D
from cloakwork.sources import readers as S


def test_structural_pairs_read_their_leaves_once(spark):
    body = '{"cfg":{"api_token":"9F86D081-884c7d65","plain":"9F86D081-884c7d65","passwords":["9A2FEAA0-c55ad015",["D0A3BF4F-1b2b0b82"]]}}'
    rows = spark.createDataFrame([(1, body), (2, '{"api_token":["short"]}')], "id long, body string")
    out = D.structural_pairs(S.flatten_leaves(rows, ["id"]), ["id"])
    assert sorted((r.id, r.path, r.value) for r in out.collect()) == [
        (1, "$.cfg.api_token", "9F86D081-884c7d65"), (1, "$.cfg.passwords[0]", "9A2FEAA0-c55ad015")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_literals_with_escapes_and_no_json(spark):
    rows = spark.createDataFrame([(0, '{"a\\u0041":["\\ud800q\\ud83d\\ude00", 1, "x\\\\"] , "b" : {}}'), (1, '{"a":'), (2, None)], "id long, body string")
    got = {r.id: r.l for r in rows.select("id", B.literals(F.col("body")).alias("l")).collect()}
    assert [(x["kind"], x["text"]) for x in got[0]] == [("key", "aA"), ("value", "?q\U0001f600"), ("value", "x\\"), ("key", "b")]
    assert [(x["kind"], x["text"]) for x in got[1]] == [("raw", '{"a":')] and [x["kind"] for x in got[2]] == ["raw"]


def test_equally_confident_entities_are_named_by_their_order(spark):
    rows = [(g, i, "some one", "NAME", "" if (g + i) % 2 else "PATIENT", "", 0.9) for g in range(20) for i in range(9)]
    df = spark.createDataFrame(rows, "grp int, i int, text string, label string, entity_type string, canonical_label string, confidence double")
    for order, first in (("i", lambda g: "name" if g % 2 else "patient"), (None, lambda g: "name")):
        got = S.read_analyzer_entities(df.repartition(7), ["grp"], order=[order] if order else [])
        assert {r.grp: r.rule for r in got.collect()} == {g: first(g) for g in range(20)}
