"""Queries of whole JSON bodies: structural secrets, memory of turns, links, identities, numbers in the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, Query, Tables, duck, spread, sql_likely, sql_typed
from catalog.redaction import _sql_tag
from cloakwork.functions.surrogates import Surrogates
from cloakwork.operators import detect as D
from cloakwork.operators import identity as I
from cloakwork.operators.detect import FINDING
from cloakwork.plans import redact as RD
from cloakwork.plans import scopes as SC

QUERIES: list[Query] = []
SUR = Surrogates(KEY)


def q(name: str, sql: str):
    def add(run):
        QUERIES.append(Query(name, run, duck(sql)))
        return run
    return add


def token(value: str, rule: str = "secret-json-value", kind: str = "secret") -> str:
    return sql_typed(value, f"'{rule}'", f"'{kind}'")


# ------------------------------------------------------------------- D21 in R1
_STRUCT = """SELECT event_id, upper(substr(h, 1, 8)) || '_' || substr(h, 9, 12) AS one, substr(h, 20, 9) || '/' || upper(substr(h, 30, 8)) AS two,
  'Zz9_' || h AS inner_value FROM (SELECT event_id, SHA[CAST(event_id AS STRING)]SHA AS h FROM {events}) x"""
_STRUCT_BODY = """'{"cfg": {"api_token": "' || ONE || '", "limits": [1, {"max_tokens": 64000}], "passwords": ["' || TWO || '", 5, ["x"]], "auth_block": {"inner": "' ||
  inner_value || '"}}, "note": "see \\"' || ONE || '\\"", "n": 12345678901234567890}'"""


def _struct(one: str, two: str) -> str:
    return _STRUCT_BODY.replace("ONE", one).replace("TWO", two)


@q("redact_bodies_structural", "SELECT event_id, " + _struct(
    f"CASE WHEN {sql_likely('one')} THEN {token('one')} ELSE one END", f"CASE WHEN {sql_likely('two')} THEN {token('two')} ELSE two END"
) + f" AS redacted FROM ({_STRUCT}) _s")
def _(t: Tables):
    rows = spread(t.sql(_STRUCT), "event_id")
    body = F.concat(F.lit('{"cfg": {"api_token": "'), "one", F.lit('", "limits": [1, {"max_tokens": 64000}], "passwords": ["'), "two",
                    F.lit('", 5, ["x"]], "auth_block": {"inner": "'), "inner_value", F.lit('"}}, "note": "see \\"'), "one",
                    F.lit('\\"", "n": 12345678901234567890}'))
    return RD.Redactor(SUR, D.SECRET_RULES).redact_bodies(rows.select("event_id", body.alias("body")), ["event_id"]).select("event_id", "redacted")


# ------------------------------------------------------------------- J5, D40 in R1
# the first turn of conv % 3 shows a token and a card; other turns only mention them, in other letter case or reflowed
_TURNS = """SELECT conv_id, turn, turn = conv_id % 3 AS shows, 'Tk_' || substr(SHA[CAST(conv_id AS STRING)]SHA, 1, 18) AS v,
  'Tk_' || substr(SHA[CAST(conv_id + 1 AS STRING)]SHA, 1, 18) AS other FROM {conversations}"""
_CARD, _FLOWED = "4111 1111 1111 1111", "4111 1111\\n1111 1111"


def _turn_body(v: str, upper: str, lower: str, card: str, flowed: str) -> str:
    return (f"CASE WHEN shows THEN '{{\"api_token\":\"' || {v} || '\",\"card\":\"no ' || {card} || '\"}}' ELSE '{{\"say\":\"' || {v} || ' or ' || {upper} || ' or ' || {lower} "
            f"|| ' not ' || other || ', card ' || {flowed} || '\"}}' END")


def _known(surface: str, value: str = "v") -> str:
    seen = {"v": f"later AND {sql_likely('v')}", "card": "later"}[value]
    made = token(surface) if value == "v" else sql_typed(surface, "'credit-card'", "'pii'")
    plain = f"'{_FLOWED}'" if surface.startswith("'4111 1111'") else surface
    return f"CASE WHEN {seen} THEN {made} ELSE {plain} END"


@q("redact_bodies_turns", "SELECT conv_id, turn, " + _turn_body(
    _known("v"), _known("upper(v)"), "lower(v)", _known(f"'{_CARD}'", "card"), _known("'4111 1111' || chr(10) || '1111 1111'", "card")
) + f" AS redacted FROM (SELECT *, turn >= min(CASE WHEN shows THEN turn END) OVER (PARTITION BY conv_id) AS later FROM ({_TURNS}) _s) _t")
def _(t: Tables):
    out, _ledger = SC.redact_turns(RD.Redactor(SUR, [*D.SECRET_RULES, *D.PII_RULES]), _turn_bodies(t), "conv_id", "turn")
    return out.select("conv_id", "turn", "redacted")


def _turn_bodies(t: Tables):
    flowed = "'" + _FLOWED.replace("\\", "\\\\") + "'"
    return t.sql(_TURNS).select("conv_id", "turn", F.expr(_turn_body("v", "upper(v)", "lower(v)", f"'{_CARD}'", flowed)).alias("body"))


@q("scope_ledger", f"""SELECT conv_id, v AS value, conv_id % 3 AS first_turn, 'secret-json-value' AS name, 1 AS version FROM ({_TURNS}) _a WHERE shows AND {sql_likely('v')}
   UNION ALL SELECT conv_id, '{_CARD}', conv_id % 3, 'credit-card', 1 FROM ({_TURNS}) _b WHERE shows""")
def _(t: Tables):
    # two runs over the same bodies: the second one adds and changes no row
    r, bodies = RD.Redactor(SUR, [*D.SECRET_RULES, *D.PII_RULES]), _turn_bodies(t)
    seen = SC.seen_values(r, bodies, "conv_id", "turn")
    once = SC.merge_ledger(SC.empty_ledger(bodies, "conv_id", "turn"), seen, "conv_id", 1)
    return SC.merge_ledger(once, seen, "conv_id", 2).select("conv_id", "value", "first_turn", "name", "version")


# ------------------------------------------------------------------- J3 in R1
# nations 0 and 1 share a short name, so it links to neither
_ORG = """SELECT n_nationkey, chr(65 + CAST(greatest(n_nationkey, 1) AS INT)) || 'elta' AS short, CASE WHEN n_nationkey < 2 THEN 2 ELSE 1 END AS owners,
  'The ' || chr(65 + CAST(greatest(n_nationkey, 1) AS INT)) || 'elta ' || chr(65 + CAST(n_nationkey AS INT)) || 'anks Ltd' AS full_name FROM {nation}"""
_ASKED = f"SELECT c_custkey, short, full_name, owners, CAST(n_nationkey AS STRING) AS k FROM {{customer}} c JOIN ({_ORG}) o ON c.c_nationkey = o.n_nationkey"


def _family(surface: str) -> str:
    return f"'{SUR.prefix}ORG_' || {_sql_tag('entity', chr(39) + 'matter' + chr(39), 'id')} || '_' || {_sql_tag('surface', chr(39) + 'matter' + chr(39), 'id', surface)}"


@q("redact_bodies_linked", f"""SELECT c_custkey, '{{"m":["' || CASE WHEN owners = 1 THEN {_family('short')} ELSE {token('short', 'organization', 'pii')} END || ' asked ' || {_family('full_name')}
   || '"]}}' AS redacted FROM (SELECT *, 'o' || k AS id FROM ({_ASKED.replace('STRING', 'VARCHAR')}) _a) _b""")
def _(t: Tables):
    registry = t.sql(_ORG).select(
        F.col("full_name").alias("value"), F.concat(F.lit("o"), F.col("n_nationkey").cast("string")).alias("entity_id"),
        F.lit("organization").alias("entity_type"), F.lit("entity").alias("protection_kind"), F.lit("token").alias("boundary"))
    none = F.lit(None).cast("int")
    found = F.array(F.struct(F.lit("organization"), none, none, F.col("short"), F.lit("pii"), F.lit("high"), F.lit("pii-analyzer"), F.lit(0.9))).cast(FINDING)
    rows = spread(t.sql(_ASKED), "c_custkey").select("c_custkey", found.alias("mentions"), F.lit("matter").alias("ctx"), F.concat(
        F.lit('{"m":["'), "short", F.lit(" asked "), "full_name", F.lit('"]}')).alias("body"))
    out = RD.Redactor(SUR, [], registry).redact_bodies(rows, ["c_custkey"], "body", "ctx", detections="mentions")
    return out.select("c_custkey", "redacted")


# ------------------------------------------------------------------- D30, V1, V2 in R1
_NAMED = """SELECT c_custkey, chr(65 + CAST(c_custkey % 26 AS INT)) || 'older Lantern Ltd' AS org, 'u' || CAST(c_custkey AS STRING) || '@corp.test' AS mail FROM {customer}"""


@q("redact_bodies_identity", f"""SELECT c_custkey, '{{"org":"we met ' || {token('org', 'organization', 'pii')} || ', then ' || {token('lower(org)', 'organization', 'pii')} || ' left","to":"'
   || {token('mail', 'email', 'pii')} || '"}}' AS redacted FROM ({_NAMED}) _n""")
def _(t: Tables):
    body = F.concat(F.lit('{"org":"we met '), "org", F.lit(", then "), F.lower("org"), F.lit(' left","to":"'), "mail", F.lit('"}'))
    rows = spread(t.sql(_NAMED), "c_custkey").select("c_custkey", body.alias("body"))
    found = RD.with_detections(rows, ["c_custkey"], "body", [
        ("identity", I.designator_organizations, "content"), ("regex", D.rule_detector(D.PII_RULES), "content")])
    return RD.Redactor(SUR).redact_bodies(found, ["c_custkey"], detections="detections").select("c_custkey", "redacted")


# the name is written with emphasis inside; its raw surface, syntax included, is replaced
_BOLD = "replace(org, ' Lantern', '** Lantern')"


@q("redact_bodies_markdown", f"""SELECT c_custkey, '{{"org":"1. we met **' || {token(_BOLD, 'organization', 'pii')} || ', \\\\# then ~~nobody~~"}}' AS redacted FROM ({_NAMED}) _n""")
def _(t: Tables):
    body = F.concat(F.lit('{"org":"1. we met **'), F.expr(_BOLD), F.lit(', \\\\# then ~~nobody~~"}'))
    rows = spread(t.sql(_NAMED), "c_custkey").select("c_custkey", body.alias("body"))
    found = RD.with_detections(rows, ["c_custkey"], "body", [("markdown", I.on_markdown(I.designator_organizations), "content")])
    return RD.Redactor(SUR).redact_bodies(found, ["c_custkey"], detections="detections").select("c_custkey", "redacted")


@q("run_detectors", f"""SELECT c_custkey, 'identity' AS detector, 'organization' AS rule, 7 AS start_pos, CAST(7 + length(org) AS BIGINT) AS end_pos FROM ({_NAMED}) _a
   UNION ALL SELECT c_custkey, 'regex', 'email', CAST(20 + length(org) AS BIGINT), CAST(20 + length(org) + length(mail) AS BIGINT) FROM ({_NAMED}) _b""")
def _(t: Tables):
    text = F.concat(F.lit("we met "), "org", F.lit(", then write "), "mail")
    rows = spread(t.sql(_NAMED), "c_custkey").select("c_custkey", text.alias("text"))
    out = D.run_detectors(rows, ["c_custkey"], "text", [
        ("identity", I.designator_organizations, "all"), ("regex", D.rule_detector(D.PII_RULES), "content")])
    return out.select("c_custkey", "detector", "rule", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"))


# ------------------------------------------------------------------- R3 with a registry and numbers
_NUMBERS = """SELECT event_id, CAST(100000000000 + event_id AS STRING) AS num, event_id % 5 = 0 AS registered FROM {events}"""


@q("leak_gate_numbers", f"""SELECT event_id, num AS leak FROM ({_NUMBERS}) _n WHERE registered""")
def _(t: Tables):
    rows = spread(t.sql(_NUMBERS), "event_id")
    registry = rows.filter("registered").select(F.col("num").alias("value"))
    # the number stands whole, longer, and as part of a string key
    body = F.concat(F.lit('{"n":['), "num", F.lit(',9'), "num", F.lit('],"k'), "event_id", F.lit('":"clean"}'))
    raw = rows.select("event_id", body.alias("body"), F.array().cast("array<struct<value:string,token_bound:boolean>>").alias("known"))
    return RD.Redactor(SUR, (), registry).gate(raw, ["event_id"], "body", json_body=True).select("event_id", F.explode("leaks").alias("leak"))
