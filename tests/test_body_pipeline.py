"""Bodies through the whole redaction: structural secrets, memory of turns, links, identities, user values."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.surrogates import Surrogates
from cloakwork.functions.text import prefix_fold
from cloakwork.operators import bodies as B
from cloakwork.operators import detect as D
from cloakwork.operators.detect import FINDING
from cloakwork.plans import redact as RD
from cloakwork.plans import scopes as SC

SUR = Surrogates("k")
SECRET = "ZX9Q_abcDEF12345678"


def table(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id long, body string")


def redacted(out):
    return {r["id"]: r["redacted"] for r in out.collect()}


def leaves(value, path=()):
    """Keys and strings of parsed JSON in structural order."""
    if isinstance(value, str):
        yield "value", path, value
    for i, x in enumerate(value if isinstance(value, list) else []):
        yield from leaves(x, (*path, i))
    for k, x in (value if isinstance(value, dict) else {}).items():
        yield "key", (*path, k), k
        yield from leaves(x, (*path, k))


def test_literals_equal_a_walk_of_the_parsed_body(spark):
    rnd = random.Random(1)

    def made(depth):
        roll = rnd.random()
        if depth == 0 or roll < 0.3:
            return rnd.choice(["x", 'a"b', "{[,:]}", "é\n", 1, 2.5, None, True, "", -3e9])
        if roll < 0.6:
            return [made(depth - 1) for _ in range(rnd.randint(0, 4))]
        return {rnd.choice(["a", "b c", 'k"', ",", "0", "é", ""]) + str(i): made(depth - 1) for i in range(rnd.randint(0, 4))}

    deep = "bottom"
    for i in range(60):
        deep = {"a": deep} if i % 2 else [deep]
    values = [made(5) for _ in range(60)] + ["root", [], {}, [[["x"], "y"], ["z", {"q": ["w"]}]], deep, [{f"k{i}": ["v", {"n": [i, "t"]}]} for i in range(200)]]
    texts = [json.dumps(v, ensure_ascii=bool(i % 2), indent=2 if i % 3 == 0 else None) for i, v in enumerate(values)]
    df = table(spark, *texts)
    for r in df.select("id", "body", B.literals(F.col("body")).alias("l")).collect():
        got = [(x["kind"], tuple(s["index"] if s["key"] is None else s["key"] for s in x["steps"]), x["text"]) for x in r["l"]]
        assert got == list(leaves(values[r["id"]]))
        assert all(json.loads(r["body"][x["at"]:x["at_end"]]) == x["text"] for x in r["l"])
    start = time.perf_counter()
    table(spark, texts[64]).select(F.transform(B.literals(F.col("body")), lambda x: B.path_of(x["steps"]))).collect()
    assert time.perf_counter() - start < 8


def test_prefix_fold_is_a_running_fold(spark):
    for n in (0, 1, 15, 16, 17, 300, 1000):
        df = spark.range(1).select(F.when(F.lit(n) > 0, F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.array().cast("array<int>")).alias("x"))
        got = df.select(prefix_fold(F.col("x"), F.lit(0), lambda a, x: a + x, lambda a, x: F.struct(a, x), "array<struct<a:int,x:int>>").alias("r")).first()["r"]
        assert [tuple(r) for r in got] == [(k * (k + 1) // 2, k) for k in range(1, n + 1)]


@pytest.mark.parametrize("body, hidden, kept", [
    ({"api_token": SECRET}, [SECRET], []),
    ({"a": [{"password": [SECRET, 7, {"x": "plain-Words-1234"}]}]}, [SECRET], ["plain-Words-1234"]),
    ({"auth_block": {"inner": SECRET}}, [], [SECRET]),
    ({"max_tokens": 64000, "output_config": SECRET}, [], [SECRET]),
    ({"api_token": SECRET, "note": f"see {SECRET}!", SECRET: 1}, [SECRET], []),
])
def test_structural_secrets_are_replaced_in_bodies(spark, body, hidden, kept):
    text = json.dumps(body)
    r = RD.Redactor(SUR, [*D.SECRET_RULES, *D.PII_RULES])
    out = r.gate(r.redact_bodies(table(spark, text), ["id"]), ["id"], json_body=True).first()
    assert all(v not in out["redacted"] for v in hidden) and all(v in out["redacted"] for v in kept)
    assert out["leaks"] == [] and json.loads(out["redacted"]) is not None
    undone = out["redacted"]
    for s in out["spans"]:
        undone = undone.replace(s["token"], s["value"])
    assert undone == text


def turns(spark, *rows):
    return spark.createDataFrame([(c, t, json.dumps(b)) for c, t, b in rows], "conv long, turn long, body string")


def test_memory_of_a_scope(spark):
    card, key = "4111 1111 1111 1111", "Tok_9fQ2-xyZ81-aa7"
    df = turns(
        spark, (1, 0, {"say": "before Tok_9fQ2-xyZ81-aa7"}), (1, 1, {"api_token": key, "c": f"card {card}"}),
        (1, 2, {"say": f"again {key.upper()} and 4111 1111\n1111 1111"}), (2, 2, {"say": f"other {key} scope"}), (1, 3, {"say": "clean"}))
    r = RD.Redactor(SUR, [*D.SECRET_RULES, *D.PII_RULES])
    out, ledger = SC.redact_turns(r, df, "conv", "turn")
    got = {(x["conv"], x["turn"]): json.loads(x["redacted"]) for x in out.collect()}
    assert got[1, 0]["say"].endswith(key) and key in got[2, 2]["say"] and got[1, 3] == {"say": "clean"}
    assert key not in got[1, 1]["api_token"] and "4111" not in got[1, 1]["c"]
    assert "4111" not in got[1, 2]["say"] and key.lower() not in got[1, 2]["say"].lower()
    rows = {(x["value"], x["first_turn"], x["version"]) for x in ledger.collect()}
    assert rows == {(key, 1, 1), (card, 1, 1)}
    # the same run again adds and changes no row; an earlier turn moves its value and nothing else
    again = SC.merge_ledger(ledger, SC.seen_values(r, df, "conv", "turn"), "conv", 2)
    assert {(x["value"], x["first_turn"], x["version"]) for x in again.collect()} == rows
    early = SC.seen_values(r, turns(spark, (1, 0, {"api_token": key})), "conv", "turn")
    assert {(x["value"], x["first_turn"], x["version"]) for x in SC.merge_ledger(ledger, early, "conv", 3).collect()} == {(key, 0, 3), (card, 1, 1)}
    # a later run knows what an earlier one has seen
    later, _ = SC.redact_turns(r, turns(spark, (1, 9, {"say": f"x {key}"}), (2, 9, {"say": f"x {key}"})), "conv", "turn", ledger=ledger)
    assert {x["conv"]: key in x["redacted"] for x in later.collect()} == {1: False, 2: True}


def test_user_values_win_in_their_scope(spark):
    df = turns(spark, (1, 0, {"say": "write to ann@corp.test about Plan Orion"}), (2, 0, {"say": "Plan Orion, ann@corp.test"}))
    user = RD.user_forms(spark.createDataFrame([(1, " Plan Orion "), (1, "ann@corp")], "conv long, value string"))
    out, _ = SC.redact_turns(RD.Redactor(SUR, D.PII_RULES), df, "conv", "turn", user=user)
    got = {x["conv"]: x for x in out.collect()}
    assert "Orion" not in got[1]["redacted"] and "Plan Orion" in got[2]["redacted"]
    own = {s["value"]: (s["source"], s["authority"]) for s in got[1]["spans"]}
    assert own["ann@corp"] == ("user-selected", "registry") and own["Plan Orion"] == ("user-selected", "registry")
    assert own[".test"][1] == "detected"                # the e-mail address lost the rest to the user's value


@pytest.mark.parametrize("inline_links", [RD.INLINE_FORMS, 0])
def test_mentions_of_one_registered_organization_share_its_family(spark, inline_links):
    registry = spark.createDataFrame(
        [("The Meridian Holdings Ltd", "o1"), ("Zephyr Bank", "o2"), ("Zephyr Lines", "o3")], "value string, entity_id string"
    ).withColumn("entity_type", F.lit("organization")).withColumn("protection_kind", F.lit("entity")).withColumn("boundary", F.lit("token"))
    body = json.dumps({"m": "Meridian called The Meridian Holdings Ltd and Zephyr"})
    found = F.transform(F.array(F.lit("Meridian"), F.lit("Zephyr")), lambda v: F.struct(
        F.lit("organization"), F.lit(None).cast("int"), F.lit(None).cast("int"), v, F.lit("pii"), F.lit("high"), F.lit("pii-analyzer"), F.lit(0.9))).cast(FINDING)
    df = table(spark, body).withColumn("mentions", found).withColumn("ctx", F.lit("c"))
    r = RD.Redactor(SUR, [], registry, inline_links=inline_links)
    out = r.redact_bodies(df, ["id"], context_col="ctx", detections="mentions").first()
    tag = {s["value"]: s["token"].split("_")[1:3] for s in out["spans"]}
    assert tag["Meridian"][0] == "ORG" and tag["Meridian"] == tag["The Meridian Holdings Ltd"]
    ids = {s["value"]: s["entity_id"] for s in out["spans"]}
    assert ids["Meridian"] == "o1" and ids["Zephyr"].startswith("detected:")        # two owners: no link


def test_limits_block_bodies(spark):
    body = json.dumps({"m": [f"u{i}@corp.test" for i in range(5)]})
    for how, over in (({"max_entities": 4}, True), ({"max_occurrences": 4}, True), ({}, False)):
        out = RD.Redactor(SUR, D.PII_RULES, **how).redact_bodies(table(spark, body), ["id"]).first()
        assert out["over_limit"] is over and (out["redacted"] is None) is over


def test_markdown_view_maps_back_to_the_raw_text(spark):
    import re

    from cloakwork.operators import identity as I

    rnd = random.Random(6)
    texts = ["", "plain", " " * 200 + "# far", "1234567890123456789012. long", "**", "\\*"] + [
        "".join(rnd.choice(["a", "b ", "\n", "# ", "- ", "12. ", "*", "~~", "`", "\\", "\\#", "\t", "é"]) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("v", I.markdown_view(F.col("t")))
    at = F.transform(F.sequence(F.lit(0), F.length("v.text")), lambda i: F.struct(
        I.to_raw(F.col("v.kept"), i).alias("s"), I.to_raw(F.col("v.kept"), i, True).alias("e")))
    for r in df.select("id", "v.text", at.alias("at")).collect():
        raw, gone = texts[r["id"]], set()
        for m in re.finditer(r"\\(?=[\\`*_{}\[\]()#+\-.!|~>])|[*~`]+", raw):
            gone |= set(range(*m.span()))
        for m in re.finditer(r"(?:^|(?<=\n))([ \t]*)(#{1,6}|[-+]|[0-9]+\.)(?=[ \t])", raw):
            gone |= set(range(*m.span(2)))
        kept = [i for i in range(len(raw)) if i not in gone]
        assert r["text"] == "".join(raw[i] for i in kept)
        assert [a["s"] for a in r["at"]][:-1] == kept and [a["e"] for a in r["at"]][1:] == [i + 1 for i in kept]
