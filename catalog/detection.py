"""Queries of the detection, gate and identity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ENV_TABLE, ORG_TEXT, SECRET_TEXT, Query, Tables, duck, lit, spread, sql_core, sql_likely, sql_literal_url, sql_luhn,
    sql_path_shaped, sql_pieces, sql_placeholder, sql_trim,
)
from cloakwork.functions import fixed
from cloakwork.functions import predicates as P
from cloakwork.functions.text import category_label, codepoint_offset, utf16_offset
from cloakwork.operators import detect as D
from cloakwork.operators import identity as I
from cloakwork.operators import registry as R
from cloakwork.operators.paths import PATH_HINT, preserved
from cloakwork.operators.spans import mark_safe, scan, semi_overlap
from cloakwork.sources import readers as S

ALL_RULES = [*D.SECRET_RULES, *D.PII_RULES, *D.DOCUMENT_RULES, *D.IDENTITY_FIELD_RULES]


def rules_named(name: str) -> list[D.Rule]:
    return [r for r in ALL_RULES if r.name == name]


def found(t: Tables, rules: list[D.Rule], source: str = SECRET_TEXT, key: str = "event_id"):
    return D.detect(t.sql(source), [key], "text", rules).select(
        key, "rule", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"),
        "value", "confidence")


_GATES = {
    "private-key": lambda v: f"length({v}) <= {fixed.MAX_PRIVATE_KEY_LEN} AND length({v}) >= 32",
    "jwt": lambda v: (
        f"json_valid(decode(from_base64(rpad(translate(split_part({v}, '.', 1), '-_', '+/'), CAST(ceil(length(split_part({v}, '.', 1)) / 4.0) * 4 AS INTEGER), '='))))"),
    "credential-url": sql_literal_url, "secret-assignment": lambda v: sql_likely(sql_core(v)),
    "secret-json-value": lambda v: sql_likely(sql_core(v)), "credit-card": sql_luhn,
}


def rule_sql(name: str, source: str = SECRET_TEXT, key: str = "event_id") -> str:
    parts = []
    for r in rules_named(name):
        pattern, groups = r.re2, 3 if (r.lead or r.tail) else 1
        where = "true"
        if name == "phone-number":
            where = "NOT regexp_matches(substr(text, start_pos, 1), '[0-9]') OR start_pos = 0"
        if name == "account-number":
            pattern, where = "([0-9]+)", "length(value) BETWEEN 9 AND 11"
        if name == "company-registration" and r.gate is not None:
            where = "regexp_matches(value, '[0-9]')"
        spans = sql_pieces(f"({duck(source)}) _s", key, "text", pattern, groups)
        gate = _GATES.get(name)
        parts.append(f"SELECT {key}, '{name}' AS rule, start_pos, end_pos, value, '{r.confidence}' AS confidence "
                     f"FROM {spans} _p WHERE ({where}) AND ({gate('value') if gate else 'true'})")
        if r.trim:
            head = f"regexp_replace({sql_trim('value')}, {lit(fixed.TRIM_HEAD)}, '')"
            parts[-1] = f"""SELECT {key}, rule, start_pos + length(value) - length({head}) AS start_pos,
              start_pos + length(value) - length({head}) + length({sql_core('value')}) AS end_pos,
              {sql_core('value')} AS value, confidence FROM ({parts[-1]}) _t
              WHERE {sql_core('value')} <> '' AND NOT {sql_placeholder(sql_core('value'))}
                AND NOT starts_with({sql_core('value')}, '{fixed.DEFAULT_PREFIX}')"""
    return " UNION ALL ".join(parts)


def _rule_query(name: str) -> Query:
    return Query(f"detect_{name.replace('-', '_')}", lambda t: found(t, rules_named(name)), rule_sql(name))


QUERIES = [_rule_query(n) for n in dict.fromkeys(r.name for r in ALL_RULES)]


def q(name: str, sql: str | None = None):
    def add(run):
        QUERIES.append(Query(name, run, duck(sql) if sql else None))
        return run
    return add


# --------------------------------------------------- whole documents (real corpus)
for _name in ("email", "credit-card", "us-ssn"):
    QUERIES.append(Query(
        f"scan_documents_{_name.replace('-', '_')}",
        lambda t, n=_name: D.detect(t.documents, ["doc_id"], "text", rules_named(n)).select(
            "doc_id", "rule", F.col("start").cast("bigint").alias("start_pos"),
            F.col("end").cast("bigint").alias("end_pos"), "value", "confidence"),
        rule_sql(_name, "SELECT doc_id, text FROM {documents}", "doc_id")))

# ------------------------------------------------------------------ gates on values
_TOKENS = f"(SELECT event_id, unnest(string_split(text, ' ')) AS value FROM ({duck(SECRET_TEXT)}) _s) _v"


def tokens(t: Tables):
    return t.sql(SECRET_TEXT).select("event_id", F.explode(F.split("text", " ")).alias("value"))


@q("gate_likely_secret", f"SELECT event_id, value, {sql_likely(sql_core('value'))} AS likely FROM {_TOKENS} "
   "WHERE NOT regexp_matches(value, 'eyJ')")
def _(t):
    return tokens(t).filter(~F.col("value").rlike("eyJ")).withColumn("likely", P.likely_secret(F.col("value")))


@q("gate_placeholder_and_url", f"""SELECT event_id, value, {sql_placeholder('value')} AS placeholder,
   {sql_literal_url('value')} AS literal_url FROM {_TOKENS}""")
def _(t):
    return tokens(t).withColumn("placeholder", P.is_placeholder(F.col("value"))).withColumn(
        "literal_url", P.is_literal_credential_url(F.col("value")))


@q("gate_path_shaped", f"SELECT event_id, value, {sql_path_shaped('value')} AS path FROM {_TOKENS}")
def _(t):
    return tokens(t).withColumn("path", P.is_path_shaped(F.col("value")))


@q("trim_candidate", f"SELECT event_id, {sql_core('value')} AS core FROM {_TOKENS}")
def _(t):
    return tokens(t).select("event_id", P.trim_candidate(F.col("value")).alias("core"))


@q("luhn", f"SELECT doc_id, value, {sql_luhn('value')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, "
   f"{lit(fixed.CREDIT_CARD)}, 1)) AS value FROM {{documents}}) _v")
def _(t):
    runs = F.regexp_extract_all("text", F.lit(fixed.java(fixed.CREDIT_CARD)), F.lit(1))
    return t.documents.select("doc_id", F.explode(runs).alias("value")).withColumn("valid", P.luhn_valid(F.col("value")))


@q("preserve_paths")
def _(t):
    text = F.concat(F.lit("cd build-"), F.col("page_id").cast("string"), F.lit("; cat /srv/build-"),
                    F.col("page_id").cast("string"), F.lit("/log && export P=/x/build-"), F.col("page_id").cast("string"),
                    F.lit(" build-"), F.col("page_id").cast("string"), F.lit(" "), F.col("url"))
    rows = t.pages.select("page_id", text.alias("text")).withColumn("value", F.concat(F.lit("build-"), F.col("page_id").cast("string")))
    spans = rows.select("page_id", "text", F.explode(scan(mark_safe(F.col("text")), r"(build-[0-9]+)")).alias("s"))
    return spans.select("page_id", F.col("s.start").alias("start_pos"), (
        F.col("text").rlike(PATH_HINT) & preserved(F.col("text"), F.col("s.start"), F.col("s.end"), F.col("s.value"))
    ).alias("kept"))


@q("secret_header", f"""SELECT event_id, 'secret-header' AS rule, {sql_core('v')} AS value, 'probabilistic' AS confidence
   FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'X-Auth-Info' WHEN 1 THEN 'Accept' ELSE 'X-Secret' END AS name, value AS v
         FROM ({ENV_TABLE}) _e) _h
   WHERE regexp_matches(name, {lit('(?i)(?:' + fixed.SECRET_WORD + ')')}) AND {sql_likely(sql_core('v'))}
     AND NOT {sql_placeholder(sql_core('v'))} AND {sql_core('v')} <> ''""")
def _(t):
    rows = t.sql(ENV_TABLE).select("event_id", "value", F.expr(
        "CASE event_id % 3 WHEN 0 THEN 'X-Auth-Info' WHEN 1 THEN 'Accept' ELSE 'X-Secret' END").alias("name"))
    return D.secret_header_findings(rows, ["event_id"], "name", "value")


_PAIR_BODY = """SELECT event_id, SHA[CAST(event_id AS STRING)]SHA AS h FROM {events}"""


@q("structural_json_pairs", f"""SELECT event_id, path, 'secret-json-value' AS rule, value, 'probabilistic' AS confidence FROM (
   SELECT event_id, '$.cfg.api_token' AS path, upper(substr(h, 1, 8)) || '-' || substr(h, 9, 8) AS value FROM ({_PAIR_BODY}) _a
   UNION ALL SELECT event_id, '$.cfg.passwords[0]', upper(substr(h, 20, 8)) || '-' || substr(h, 30, 8) FROM ({_PAIR_BODY}) _b) _u
   WHERE {sql_likely('value')}""")
def _(t):
    h = F.col("h")
    body = F.to_json(F.struct(
        F.struct(
            F.concat(F.upper(F.substring(h, 1, 8)), F.lit("-"), F.substring(h, 9, 8)).alias("api_token"),
            F.array(F.concat(F.upper(F.substring(h, 20, 8)), F.lit("-"), F.substring(h, 30, 8)), F.lit("x")).alias("passwords"),
            F.struct(F.concat(F.lit("Zz9-"), h).alias("inner")).alias("auth_block"),
        ).alias("cfg"), F.lit(64000).alias("max_tokens"), F.lit("low").alias("effort")))
    leaves = S.flatten_leaves(spread(t.sql(_PAIR_BODY), "event_id").select("event_id", body.alias("body")), ["event_id"])
    return D.structural_pairs(leaves, ["event_id"])


# -------------------------------------------------------------------- country, score
@q("country_scope", " UNION ALL ".join(
    f"SELECT rule, count(*) AS n FROM ({rule_sql(n)}) _r GROUP BY rule" for n in ("document-id", "account-number")))
def _(t):
    return D.detect(t.sql(SECRET_TEXT), ["event_id"], "text", D.country_scope(D.DOCUMENT_RULES, [])).groupBy("rule").agg(
        F.count("*").alias("n"))


@q("context_score")
def _(t):
    f = D.detect(t.sql(SECRET_TEXT), ["event_id"], "text", D.DOCUMENT_RULES)
    lifted = D.with_context_score(f.join(t.sql(SECRET_TEXT).select("event_id", "text"), "event_id"), "text")
    return lifted.filter(F.col("score") >= fixed.SCORE_THRESHOLD).select("event_id", "rule", "value", "score")


# --------------------------------------------------------------------- external spans
_SPANS = """SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PHONE_NUMBER' WHEN 2 THEN 'LOCATION'
  WHEN 3 THEN NULL ELSE 'ORGANIZATION' END AS entity_type, doc_id % 40 AS start_at, doc_id % 40 + doc_id % 17 AS end_at,
  CAST(doc_id % 10 AS DOUBLE) / 10.0 AS score FROM {documents}"""


@q("analyzer_spans", f"""SELECT doc_id, rule, start_pos, start_pos + length(value) AS end_pos, value, confidence FROM (
  SELECT doc_id, replace(lower(entity_type), '_', '-') AS rule, value,
    start_at + length(raw) - length(regexp_replace(raw, {lit(f'^[{fixed.WS}]+')}, '')) AS start_pos,
    CASE WHEN score >= 0.85 THEN 'high' ELSE 'probabilistic' END AS confidence, entity_type
  FROM (SELECT *, {sql_trim('raw')} AS value FROM (SELECT *, substr(text, start_at + 1, end_at - start_at) AS raw
        FROM ({_SPANS}) _s WHERE entity_type IS NOT NULL AND end_at > start_at AND end_at <= length(text) AND score >= 0.5) _r) _v
  WHERE length(value) >= 4 AND NOT (entity_type IN ('LOCATION', 'ORGANIZATION', 'PERSON')
    AND (contains(value, chr(9)) OR NOT regexp_matches(value, '\\p{{L}}')))) _o""")
def _(t):
    spans = t.sql(_SPANS).withColumnsRenamed({"start_at": "start", "end_at": "end"})
    return S.read_analyzer_spans(spans).select(
        "doc_id", "rule", F.col("start").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), "value", "confidence")


_ENTITIES = """SELECT doc_id % 200 AS grp, doc_id, substr(text, 1, 3 + doc_id % 9) AS text, 'NAME' AS label,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'PATIENT_NAME' END AS entity_type, '' AS canonical_label,
  CAST(doc_id % 100 AS DOUBLE) / 100.0 AS confidence FROM {documents}"""


@q("analyzer_entities", f"""SELECT grp, value, arg_max(replace(lower(label2), '_', '-'), confidence) AS rule,
   CASE WHEN max(confidence) >= 0.85 THEN 'high' ELSE 'probabilistic' END AS confidence, 'pii-medical' AS source, 'pii' AS kind
   FROM (SELECT grp, {sql_trim('text')} AS value, CASE WHEN entity_type <> '' THEN entity_type ELSE label END AS label2, confidence
         FROM ({_ENTITIES}) _e WHERE confidence >= 0.5) _v WHERE length(value) >= 4 GROUP BY grp, value""")
def _(t):
    return S.read_analyzer_entities(t.sql(_ENTITIES), ["grp"], order=["doc_id"])


# --------------------------------------------------------------------- D30 … D36
@q("designator_organizations")
def _(t):
    docs = t.sql(ORG_TEXT)
    spans = I.designator_organizations(docs, ["doc"])
    return spans.join(docs, "doc").select("doc", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("value"))


@q("organization_aliases")
def _(t):
    docs = spread(t.sql(ORG_TEXT), "doc")
    orgs = I.designator_organizations(docs, ["doc"]).join(docs, "doc").withColumn(
        "value", F.expr("substring(text, start + 1, end - start)")).select("doc", "value")
    return I.organization_aliases(orgs, docs, ["doc"])


_ORG_SPANS = """SELECT doc, text, 'ORGANIZATION' AS entity_type, n FROM (
  SELECT o_orderkey AS doc, 'Blue Lantern Ltd hired Blue and Blue. Red Oak Inc, Red Elm Inc: Red or Red' AS text,
    o_orderkey % 3 AS n FROM {orders}) x"""


@q("linked_single_words", f"""SELECT doc, start_pos, start_pos + 4 AS end_pos, 'blue' AS alias
   FROM (SELECT o_orderkey AS doc, unnest([23, 32]) AS start_pos FROM {{orders}}) _x""")
def _(t):
    base = spread(t.sql(_ORG_SPANS), "doc")
    full = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((0, 16), (38, 49), (51, 62))])
    single = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((0, 4), (23, 27), (32, 36), (64, 67), (71, 74))])

    def rows(arr):
        return base.select("doc", "text", F.explode(arr).alias("s")).select(
            "doc", "s.start", "s.end", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("value"),
            F.lit("organization").alias("rule"))
    return I.linked_single_words(rows(single), rows(full), ["doc"]).select(
        "doc", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), "alias")


@q("letter_spaced_names", """SELECT doc, start_pos, end_pos, value, rule FROM (SELECT o_orderkey AS doc FROM {orders} WHERE o_orderkey % 8 = 3) _o,
   (VALUES (8, 24, 'y J o h n  D o e', 'person'), (34, 47, 'A C M E L T D', 'organization')) _v(start_pos, end_pos, value, rule)""")
def _(t):
    out = I.letter_spaced_names(t.sql(ORG_TEXT), ["doc"])
    return out.select("doc", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "value", "rule")


@q("tabular_organizations", """SELECT o_orderkey AS doc, 36 AS start_pos, 44 AS end_pos, 'Acme Pty' AS value
   FROM {orders} WHERE o_orderkey % 8 = 2""")
def _(t):
    out = I.tabular_organizations(t.sql(ORG_TEXT), ["doc"])
    return out.select("doc", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "value")


@q("identity_admission", """SELECT doc, entity_type, value, accepted FROM (SELECT o_orderkey AS doc FROM {orders} WHERE o_orderkey % 8 = 6) _o,
   (VALUES ('PERSON', 'Mary Jane Watson', true), ('PERSON', 'Mary', true), ('LOCATION', '5 Oak Lane', true), ('PERSON', 'came', false),
           ('ORGANIZATION', 'Oak Lane', false)) _v(entity_type, value, accepted)""")
def _(t):
    spans = [("PERSON", 9, 25), ("PERSON", 27, 31), ("PERSON", 32, 36), ("LOCATION", 59, 69), ("ORGANIZATION", 61, 69)]
    arr = F.array(*[F.struct(F.lit(e).alias("entity_type"), F.lit(a).alias("start"), F.lit(b).alias("end")) for e, a, b in spans])
    rows = t.sql(ORG_TEXT).filter("doc % 8 = 6").select("doc", "text", F.explode(arr).alias("s")).select("doc", "text", "s.*")
    return I.admit_identity(rows, ["doc"]).select("doc", "entity_type", "value", "accepted")


@q("markdown_view", f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, {lit(r'\\([\\`*_{}\[\]()#+\-.!|~>])')}, '\\1', 'g'),
   '[*~`]+', '', 'g'), {lit(r'(?m)^([ \t]*)(?:#{1,6}|[-+]|[0-9]+\.)([ \t])')}, '\\1\\2', 'g') AS clean FROM {{documents}}""")
def _(t):
    return t.documents.select("doc_id", I.markdown_view(F.col("text"))["text"].alias("clean"))


@q("markdown_offsets")
def _(t):
    view = t.documents.select("doc_id", "text", I.markdown_view(F.col("text")).alias("v"))
    spans = view.select("doc_id", "text", "v", F.explode(scan(mark_safe(F.col("v.text")), fixed.EMAIL)).alias("s"))
    return spans.select("doc_id", "s.value", I.to_raw(F.col("v.kept"), F.col("s.start")).alias("raw_start"),
                        I.to_raw(F.col("v.kept"), F.col("s.end"), True).alias("raw_end"))


# --------------------------------------------------------------------- D38 … D42
_MERGE = """SELECT doc_id % 50 AS doc, substr(text, 1, 4) AS value, CASE doc_id % 3 WHEN 0 THEN 'high' ELSE 'probabilistic' END AS confidence,
  CASE doc_id % 2 WHEN 0 THEN 'pii-regex' ELSE 'pii-medical' END AS source, 'person' AS rule, 'pii' AS kind,
  CAST(doc_id % 7 AS INT) AS start_at, CAST(doc_id % 7 + 4 AS INT) AS end_at FROM {documents}"""


@q("merge_findings", f"""SELECT doc, value, arg_min(confidence, ord) AS confidence, arg_min(source, ord) AS source, count(DISTINCT start_at) AS spans
   FROM (SELECT *, (CASE confidence WHEN 'high' THEN '1' ELSE '2' END) || (CASE source WHEN 'pii-medical' THEN '0' ELSE '1' END) || source AS ord
         FROM ({_MERGE}) _m WHERE {sql_trim('value')} <> '') _o GROUP BY doc, value""")
def _(t):
    rows = t.sql(_MERGE).withColumnsRenamed({"start_at": "start", "end_at": "end"})
    return D.merge_findings(rows, ["doc"]).select("doc", "value", "confidence", "source", F.size("spans").cast("bigint").alias("spans"))


def sql_chunks(size: int, overlap: int) -> str:
    """Lines of the texts in order, packed one after the other; a longer line is cut hard."""
    n, step = "length(line)", size - overlap
    joins = f"open AND stop > base AND pos + {n} - base <= {size}"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE length(text) > {size}),
  w AS (SELECT doc_id, 0 AS i, 0::BIGINT AS pos, false AS open, 0::BIGINT AS base, 0::BIGINT AS stop, []::STRUCT(b BIGINT, e BIGINT)[] AS out FROM d
    UNION ALL SELECT doc_id, i + 1, pos + {n} + 1, {n} <= {size}, CASE WHEN {n} <= {size} AND NOT ({joins}) THEN pos ELSE base END,
      CASE WHEN {n} <= {size} THEN pos + {n} ELSE stop END,
      CASE WHEN NOT ({joins}) AND open AND stop > base THEN [{{'b': base, 'e': stop}}] ELSE [] END || CASE WHEN {n} > {size} THEN
        list_transform(range(0, CAST(ceil(({n} - {size}) / {step}) AS BIGINT) + 1), lambda k: {{'b': pos + k * {step}, 'e': least(pos + k * {step} + {size}, pos + {n})}}) ELSE [] END
    FROM (SELECT w.*, lines[i + 1] AS line, len(lines) AS m FROM w JOIN d USING (doc_id) WHERE i < len(lines)) _l),
  r AS (SELECT doc_id, i, unnest(out) AS c FROM w UNION ALL
    SELECT doc_id, i + 1, {{'b': base, 'e': stop}} FROM (SELECT w.*, len(lines) AS m FROM w JOIN d USING (doc_id)) _e WHERE i = m AND open AND stop > base)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c.b, c.e) - 1 AS chunk, c.b AS base, substr(text, c.b + 1, c.e - c.b) AS text FROM r JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 0, 0, text FROM documents WHERE length(text) <= {size}"""


@q("chunk_text", sql_chunks(fixed.MAX_CHUNK_CHARS, fixed.CHUNK_OVERLAP))
def _(t):
    out = D.chunk_text(t.documents, ["doc_id"], "text")
    return out.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("base").cast("bigint").alias("base"), "text")


@q("chunk_text_small_windows", sql_chunks(500, 20))
def _(t):
    out = D.chunk_text(t.documents, ["doc_id"], "text", 500, 20)
    return out.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("base").cast("bigint").alias("base"), "text")


@q("detect_distinct_texts", "SELECT doc_id, rule, start_pos, end_pos, value FROM ("
   + rule_sql("email", "SELECT doc_id, text FROM {documents}", "doc_id") + ") _e")
def _(t):
    out = D.detect_distinct(t.documents, ["doc_id"], "text", rules_named("email"))
    return out.select("doc_id", "rule", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), "value")


@q("incremental_sweep", """SELECT count(*) AS fresh, count(DISTINCT conv_id) AS scopes FROM {conversations} c
   WHERE NOT EXISTS (SELECT 1 FROM {conversations} s WHERE s.conv_id = c.conv_id AND s.text = c.text AND s.turn % 3 <> 0)""")
def _(t):
    c = t.conversations
    swept = c.withColumn("leaf_hash", F.sha2("text", 256)).withColumn("complete", F.col("turn") % 3 != 0)
    empty = swept.select("conv_id", "leaf_hash").limit(0)
    ledger = D.grow_ledger(empty, swept, "conv_id")
    return D.fresh_leaves(c, ledger, "conv_id").agg(F.count("*").alias("fresh"), F.count_distinct("conv_id").alias("scopes"))


_STATUS = """SELECT event_id % 500 AS request_id, event_id % 9 > 0 AS available,
   CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS fail_closed FROM {events}"""


@q("outage_policy", f"""SELECT request_id, bool_and(available) AS complete, bool_or(NOT available AND coalesce(fail_closed, false)) AS blocked,
   count(*) FILTER (WHERE NOT available) AS outages FROM ({_STATUS}) _s GROUP BY request_id""")
def _(t):
    return D.outage_route(t.sql(_STATUS))




@q("classify_environment", f"""WITH e AS (SELECT * FROM ({ENV_TABLE}) _t WHERE value <> '' AND name <> ''),
  v AS (SELECT name, event_id, value, regexp_matches(value, {lit('(?i)' + fixed.CREDENTIAL_QUERY)}) OR regexp_matches(value, {lit(fixed.TOKEN_PREFIX)})
     OR regexp_matches(run, '^[0-9a-fA-F]{{24,}}$') OR (length(run) >= 16 AND ent >= CASE WHEN length(run) >= 32 THEN 3.0 ELSE 3.5 END) AS cred,
     CASE WHEN regexp_matches(value, {lit('(?i)' + fixed.URL_SCHEME)}) THEN {lit(fixed.REASON_URL)}
       WHEN regexp_matches(value, {lit(fixed.EXPLICIT_PATH)}) THEN {lit(fixed.REASON_PATH)}
       WHEN regexp_matches(value, {lit('(?i)' + fixed.CONFIG_VALUE)}) OR (length(value) <= 32 AND regexp_matches(value, {lit('(?i)' + fixed.WORD_SLUG)}))
       THEN {lit(fixed.REASON_CONFIG)} END AS shape
   FROM (SELECT *, list_sum(list_transform(list_distinct(string_split(run, '')), lambda c:
       -(len(list_filter(string_split(run, ''), lambda x: x = c)) / length(run)) * log2(len(list_filter(string_split(run, ''), lambda x: x = c)) / length(run)))) AS ent
     FROM (SELECT *, list_reduce(string_split_regex(value, '[^A-Za-z0-9]+'), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS run FROM e) _r) _n),
  g AS (SELECT name, bool_or(cred) AS cred, bool_and(shape IS NOT NULL) AS benign, arg_min(coalesce(shape, ''), event_id) AS shape FROM v GROUP BY name),
  r AS (SELECT name, CASE WHEN cred THEN NULL WHEN upper(name) IN ({', '.join(lit(n) for n in fixed.BENIGN_NAMES)})
      OR regexp_matches(name, {lit('(?i)' + fixed.BENIGN_NAME_PATTERN)}) THEN {lit(fixed.REASON_NAME)}
      WHEN regexp_matches(name, {lit('(?i)' + fixed.CLASSIFY_SECRET_NAME)}) OR regexp_matches(name, {lit('(?i)' + fixed.CLASSIFY_PII_NAME)}) THEN NULL
      WHEN benign THEN shape END AS reason FROM g)
  SELECT name, CASE WHEN reason IS NULL THEN 'keep-protected' ELSE 'likely-non-secret' END AS verdict, reason FROM r""")
def _(t):
    return R.classify_environment(t.sql(ENV_TABLE).filter("value <> '' and name <> ''"), ["event_id"])


@q("utf16_offsets", """SELECT doc_id, n_chars AS points, n_chars + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units, n_chars AS back
   FROM (SELECT doc_id, text, length(text) AS n_chars FROM {documents}) _d""")
def _(t):
    n = F.length("text")
    units = utf16_offset(F.col("text"), n)
    return t.documents.select("doc_id", n.cast("bigint").alias("points"), units.cast("bigint").alias("units"),
                              codepoint_offset(F.col("text"), units).cast("bigint").alias("back"))


@q("category_label", "SELECT DISTINCT p_name_kind AS kind, replace(lower(p_name_kind), '_', '-') AS label FROM "
   "(SELECT upper(event_type) || '_KIND' AS p_name_kind FROM {events}) _e")
def _(t):
    return t.events.select(F.concat(F.upper("event_type"), F.lit("_KIND")).alias("kind")).distinct().withColumn(
        "label", category_label(F.col("kind")))


_TOK = "SELECT doc_id, text, doc_id % 60 AS start_at, doc_id % 60 + 1 + doc_id % 5 AS end_at FROM {documents}"


@q("outside_surrogates", f"""SELECT o.doc_id, o.start_at AS start_pos, o.end_at AS end_pos FROM ({_TOK}) o WHERE NOT EXISTS (
   SELECT 1 FROM (SELECT doc_id, unnest(range(10, 60, 25)) AS s FROM {{documents}}) k
   WHERE k.doc_id = o.doc_id AND k.s < o.end_at AND o.start_at < k.s + 9)""")
def _(t):
    occ = t.sql(_TOK).select("doc_id", F.col("start_at").alias("start"), F.col("end_at").alias("end"))
    minted = t.documents.select("doc_id", F.explode(F.expr("array(10L, 35L)")).alias("start")).withColumn("end", F.col("start") + 9)
    return semi_overlap(occ, minted, ["doc_id"], anti=True).select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))



