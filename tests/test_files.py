"""Readers and writers on real files: round trips, fatal conflicts, rejects."""

import json

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.surrogates import Surrogates
from cloakwork.operators import detect as D
from cloakwork.plans import redact as RD
from cloakwork.sources import readers as S
from cloakwork.sources import writers as WR

ENTRIES = ("id string, protection_kind string, entity_type string, type string, value string, "
           "forms array<struct<value:string,kind:string,boundary:string>>, status string")
NOW = "2024-01-02T03:04:05.678Z"


def test_env_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / ".env").write_text('export KEY="one\\ntwo" # note\n# OTHER=x\nBARE= value # c\nOPEN="rest of it\nall', encoding="utf-8")
    (tmp_path / "b.env").write_text("X='it is'\r\nY=\n", encoding="utf-8")
    rows = S.load_dotenv(spark, [str(tmp_path / "a" / ".env"), str(tmp_path / "b.env")]).collect()
    got = {(r["path"].rsplit("/", 1)[1], r["name"]): r["value"] for r in rows}
    assert got == {(".env", "KEY"): "one\ntwo", (".env", "BARE"): "value", (".env", "OPEN"): "rest of it\nall", ("b.env", "X"): "it is", ("b.env", "Y"): ""}


def entries(spark, *rows):
    return spark.createDataFrame(rows, ENTRIES)


def test_registry_round_trip(spark, tmp_path):
    rows = [(f"l{i}", "literal", None, "token", f"literal-value-{i}", [(f"LITERAL-value-{i}", "alias", "substring"), (f"other-{i}", "alias", "substring")], "approved") for i in range(40)]
    rows += [("e1", "entity", "organization", "org", "Acme Holdings", [("Acme", "short_name", "token"), ("acme holdings", "alias", "substring")], "approved"),
             ("no", "literal", None, "token", "not-approved", [], "suggested")]
    out = str(tmp_path / "registry")
    WR.write_registry(WR.render_registry(entries(spark, *rows)), out, "r1", NOW, max_bytes=1500)
    files = list((tmp_path / "registry").glob("*.json"))
    assert len(files) > 2 and all(len(f.read_bytes()) < 6000 for f in files)
    back = {(r["entity_id"], r["value"], r["boundary"], r["protection_kind"]) for r in S.load_managed_registry(spark, out).collect()}
    want = {(f"l{i}", f"literal-value-{i}", "substring", "literal") for i in range(40)}
    assert want < back and ("e1", "Acme Holdings", "substring", "entity") in back and ("e1", "Acme", "token", "entity") in back
    assert {v for _, v, _, _ in back} == {v for _, v, _, _ in want} | {f"other-{i}" for i in range(40)} | {"Acme Holdings", "Acme"}


@pytest.mark.parametrize("second, problem", [
    ({"id": "a", "protectionKind": "literal", "value": "second"}, "duplicate-id"),
    ({"id": "b", "protectionKind": "literal", "value": " FIRST  value"}, "shared-surface"),
    ({"id": "c", "protectionKind": "literal", "value": " "}, "invalid managed registry entry"),
    ({"id": "d", "protectionKind": "entity", "canonicalValue": "x", "entityType": "planet", "forms": []}, "invalid managed registry entry"),
])
def test_registry_conflicts_are_fatal(spark, tmp_path, second, problem):
    for i, entry in enumerate(({"id": "a", "protectionKind": "literal", "value": "first value"}, second)):
        (tmp_path / f"{i}.json").write_text(json.dumps(
            {"schema": fixed.REGISTRY_SCHEMA, "revision": "r", "generatedBy": "t", "generatedAt": NOW, "entries": [entry]}))
    with pytest.raises(S.RegistryConflict, match=problem):
        S.load_managed_registry(spark, str(tmp_path))


def test_csv_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'Value,Protection Kind,Entity-Type,Forms,Status\n"Acme, ""Inc""",entity,organization,Acme~short_name~token;ACME~alias~token,\n'
        "plain,,,,suggested\n,,,,\n  ,literal,,,\nbad,literal,,x~alias~token,\n\"two\nlines\",,,,\n", encoding="utf-8")
    good, bad = S.import_registry_csv(spark, str(tmp_path / "a.csv"))
    got = {r["value"]: (r["row"], r["protection_kind"], r["status"], [tuple(f) for f in r["forms"]]) for r in good.collect()}
    assert got == {'Acme, "Inc"': (2, "entity", "approved", [("Acme", "short_name", "token")]), "plain": (3, "literal", "suggested", []),
                   "two lines": (6, "literal", "approved", [])}
    assert {(r["row"], r["reason"]) for r in bad.collect()} == {(4, "value is blank"), (5, "literal forms must use substring boundaries")}
    (tmp_path / "b.csv").write_text("no header,approved\nother,ignored\n", encoding="utf-8")
    good, _ = S.import_registry_csv(spark, str(tmp_path / "b.csv"))
    assert {(r["row"], r["value"], r["status"]) for r in good.collect()} == {(1, "no header", "approved"), (2, "other", "ignored")}


def test_outputs_hold_no_values_unless_asked(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", "write ann@corp.test"), (2, "y", "nothing")], "id long, wire string, text string")
    done = RD.Redactor(Surrogates("k"), D.PII_RULES).redact(docs, ["id"])
    with pytest.raises(ValueError, match="restricted"):
        WR.write_outputs(done, RD.dictionary_of(done, ["id"]), str(tmp_path / "bad"))
    WR.write_outputs(done, RD.dictionary_of(done, ["id"]), str(tmp_path / "out"), str(tmp_path / "locked"), partition_by="wire")
    assert (tmp_path / "out" / "corpus" / "wire=x").is_dir()
    corpus, found = spark.read.parquet(str(tmp_path / "out" / "corpus")), spark.read.parquet(str(tmp_path / "out" / "findings"))
    assert "text" not in corpus.columns and "value" not in found.columns and found.count() == 1
    assert corpus.filter(F.col("redacted").contains("ann@corp.test")).count() == 0
    assert spark.read.parquet(str(tmp_path / "locked" / "dictionary")).first()["value"] == "ann@corp.test"
