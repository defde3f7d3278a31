"""Queries of the sources, registry and policy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ENV_TABLE, Query, Tables, duck, lit
from cloakwork.functions import fixed
from cloakwork.operators import match as M
from cloakwork.operators import registry as R
from cloakwork.plans import meta as MT
from cloakwork.sources import readers as S
from cloakwork.sources import writers as WR

QUERIES: list[Query] = []
B = "bigint"


def q(name: str, sql: str | None = None):
    def add(run):
        QUERIES.append(Query(name, run, duck(sql) if sql else None))
        return run
    return add


# ---------------------------------------------------------------------------- S1 … S3
_DOTENV = """SELECT event_id, '# top' || chr(10) || 'export TOKEN_' || CAST(user_id AS STRING) || '="a' || chr(92) || 'n' || CAST(event_id AS STRING) || '"'
  || chr(10) || 'PLAIN = value-' || CAST(event_id AS STRING) || ' # note' || chr(10) || 'bad line' || chr(10) || 'MULTI=''l1' || chr(10) || 'l2 ' || event_type || ''''
  || chr(10) || 'OPEN="rest ' || CAST(event_id AS STRING) AS text FROM {events}"""


@q("load_dotenv", """SELECT event_id, pos, name, value FROM (
   SELECT event_id, 0 AS pos, 'TOKEN_' || CAST(user_id AS VARCHAR) AS name, 'a' || chr(10) || CAST(event_id AS VARCHAR) AS value FROM {events}
   UNION ALL SELECT event_id, 1, 'PLAIN', 'value-' || CAST(event_id AS VARCHAR) FROM {events}
   UNION ALL SELECT event_id, 2, 'MULTI', 'l1' || chr(10) || 'l2 ' || event_type FROM {events}
   UNION ALL SELECT event_id, 3, 'OPEN', 'rest ' || CAST(event_id AS VARCHAR) FROM {events}) _e""")
def _(t):
    return t.sql(_DOTENV).select("event_id", F.posexplode(S.parse_dotenv(F.col("text"))).alias("pos", "e")).select(
        "event_id", "pos", "e.name", "e.value")


_SECRETISH = f"NOT upper(name) IN ('PWD', 'OLDPWD') AND regexp_matches(name, {lit('(?i)' + fixed.SECRETISH_ENV)})"


@q("load_env_snapshot", f"SELECT event_id, source, name, value FROM ({ENV_TABLE}) e WHERE value <> '' AND name <> '' AND {_SECRETISH}")
def _(t):
    return S.load_env_snapshot(t.sql(ENV_TABLE), "secret-ish")


@q("load_env_snapshot_all", f"SELECT event_id, source, name, value FROM ({ENV_TABLE}) e WHERE value <> '' AND name <> ''")
def _(t):
    return S.load_env_snapshot(t.sql(ENV_TABLE), "all")


@q("admit_min_len", f"SELECT event_id, value FROM ({ENV_TABLE}) e WHERE length(value) >= 8")
def _(t):
    return S.admit_min_len(t.sql(ENV_TABLE)).select("event_id", "value")


_DUMP = """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '[1]' WHEN event_id % 50 = 1 THEN 'not json'
  ELSE '{{"KEY_' || CAST(user_id AS STRING) || '":"value-' || CAST(event_id % 400 AS STRING) || '","N":5,"S":"tiny"}}' END AS dump FROM {events}"""


@q("load_secret_dumps", """SELECT value, min(event_id) AS event_id FROM (SELECT event_id, 'value-' || CAST(event_id % 400 AS VARCHAR) AS value
   FROM {events} WHERE event_id % 50 > 1) _d WHERE length(value) >= 8 GROUP BY value""")
def _(t):
    dumps = t.sql(_DUMP.replace("{{", "' || chr(123) || '").replace("}}", "' || chr(125) || '"))
    loaded, _rejected = S.load_secret_dumps(dumps, ["event_id"])
    return loaded.select("value", "event_id")


@q("rejected_secret_dumps", """SELECT event_id, CASE event_id % 50 WHEN 0 THEN 'unsupported_json' ELSE 'invalid_json' END AS status
   FROM {events} WHERE event_id % 50 <= 1""")
def _(t):
    dumps = t.sql(_DUMP.replace("{{", "' || chr(123) || '").replace("}}", "' || chr(125) || '"))
    return S.load_secret_dumps(dumps, ["event_id"])[1].select("event_id", "status")


@q("source_load_stats", f"""WITH m AS (SELECT *, CASE WHEN value = '' OR name = '' THEN 'empty' WHEN NOT ({_SECRETISH}) THEN 'name-filtered'
     WHEN length(value) < 8 THEN 'too-short' END AS reason FROM ({ENV_TABLE}) e),
   d AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY source, name, value, reason IS NULL ORDER BY event_id) > 1
     THEN 'duplicate' ELSE reason END AS r FROM m)
   SELECT source, count(*) FILTER (WHERE r IS NULL) AS loaded, count(*) FILTER (WHERE r = 'empty') AS skipped_empty,
     count(*) FILTER (WHERE r = 'too-short') AS skipped_too_short, count(*) FILTER (WHERE r = 'duplicate') AS skipped_duplicate,
     count(*) FILTER (WHERE r = 'name-filtered') AS skipped_name_filter FROM d GROUP BY source""")
def _(t):
    return S.source_load_stats(S.mark_load(t.sql(ENV_TABLE), ["event_id"], mode="secret-ish"))


# ------------------------------------------------------------------------------ S4, S10
def _managed(t: Tables):
    form = F.struct(F.concat(F.lit("Cust "), F.col("c_custkey").cast("string")).alias("value"), F.lit("alias").alias("kind"),
                    F.lit("token").alias("boundary"))
    same = F.struct(F.upper("c_name").alias("value"), F.lit("alias").alias("kind"), F.lit("token").alias("boundary"))
    shared = F.struct(F.concat(F.lit("shared "), (F.col("c_custkey") % 500).cast("string")).alias("value"), F.lit("alias").alias("kind"),
                      F.lit("substring").alias("boundary"))
    none = F.array().cast("array<struct<value:string,kind:string,boundary:string>>")
    return t.customer.select(
        F.concat(F.lit("c"), (F.col("c_custkey") - F.when(F.col("c_custkey") % 100 == 1, 1).otherwise(0)).cast("string")).alias("id"),
        F.lit("entity").alias("protectionKind"), F.lit("organization").alias("entityType"), F.col("c_name").alias("canonicalValue"),
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("semanticType"),
        F.when(F.col("c_custkey") % 10 == 0, F.array(form, same, shared)).otherwise(none).alias("forms"))


@q("managed_registry_conflicts", """SELECT 'duplicate-id' AS problem, id AS subject, count(*) AS n FROM (SELECT 'c' || CAST(c_custkey - CASE WHEN c_custkey % 100 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS id
   FROM {customer}) _c GROUP BY id HAVING count(*) > 1
   UNION ALL SELECT 'shared-surface', sha256(norm), count(DISTINCT c_custkey) FROM (SELECT 'shared ' || CAST(c_custkey % 500 AS VARCHAR) AS norm, c_custkey
   FROM {customer} WHERE c_custkey % 10 = 0) _s GROUP BY norm HAVING count(DISTINCT c_custkey) > 1""")
def _(t):
    entries = _managed(t)
    return S.registry_conflicts(entries, S.managed_forms(entries))


@q("managed_registry_forms", """SELECT entity_id, value, boundary, substr(sha256(lower(value)), 1, 16) AS print FROM (
   SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS entity_id, n_name AS value, 'substring' AS boundary FROM {nation}
   UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'Land ' || CAST(n_nationkey AS VARCHAR), 'token' FROM {nation}) _f""")
def _(t):
    forms = F.array(
        F.struct(F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("value"), F.lit("alias").alias("kind"), F.lit("token").alias("boundary")),
        F.struct(F.lower("n_name").alias("value"), F.lit("alias").alias("kind"), F.lit("token").alias("boundary")))
    entries = t.nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("entity").alias("protectionKind"),
        F.lit("organization").alias("entityType"), F.col("n_name").alias("canonicalValue"), F.lit(None).cast("string").alias("value"),
        forms.alias("forms"))
    return S.managed_forms(entries).select("entity_id", "value", "boundary", F.split_part("form_id", F.lit(":"), F.lit(2)).alias("print"))


def _entries(t: Tables):
    return t.supplier.select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.when(F.col("s_suppkey") % 2 == 0, "entity").otherwise("literal").alias("protection_kind"),
        F.when(F.col("s_suppkey") % 2 == 0, "organization").alias("entity_type"), F.lit("vendor").alias("type"), F.col("s_name").alias("value"),
        F.array(F.struct(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("value"), F.lit("alias").alias("kind"), F.lit("substring").alias("boundary"))).alias("forms"),
        F.when(F.col("s_suppkey") % 5 == 0, "suggested").otherwise("approved").alias("status"))


@q("render_registry", """SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'entity' ELSE 'literal' END AS kind, s_name AS surface,
   CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS forms FROM {supplier} WHERE s_suppkey % 5 > 0
   UNION ALL SELECT CAST(s_suppkey AS VARCHAR) || ':form:' || substr(sha256(lower('S-' || CAST(s_suppkey AS VARCHAR))), 1, 16), 'literal', 'S-' || CAST(s_suppkey AS VARCHAR), 0
   FROM {supplier} WHERE s_suppkey % 5 > 0 AND s_suppkey % 2 = 1""")
def _(t):
    return WR.render_registry(_entries(t)).select(
        "id", F.col("protectionKind").alias("kind"), F.coalesce("canonicalValue", "value").alias("surface"),
        F.coalesce(F.size("forms"), F.lit(0)).alias("forms")).withColumn("forms", F.greatest("forms", F.lit(0)))


# ----------------------------------------------------------------------------------- S5
_CSV = """SELECT c_custkey AS row, CASE c_custkey % 4 WHEN 0 THEN 'Entity' WHEN 1 THEN '' WHEN 2 THEN 'literal' ELSE 'thing' END AS protection_kind,
  CASE c_custkey % 3 WHEN 0 THEN 'organization' ELSE 'planet' END AS entity_type, '' AS matter_id,
  CASE c_custkey % 5 WHEN 0 THEN 'Client' WHEN 1 THEN '' WHEN 2 THEN 'weird' ELSE 'vendor' END AS type,
  CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END AS value,
  CASE c_custkey % 6 WHEN 0 THEN 'A~alias~token;a~alias~substring' WHEN 1 THEN 'broken' ELSE '' END AS forms,
  CASE c_custkey % 9 WHEN 0 THEN 'maybe' ELSE 'Approved' END AS status FROM {customer}"""
_CSV_REASON = """CASE WHEN c_custkey % 7 = 0 THEN 'value is blank' WHEN c_custkey % 5 = 2 THEN 'type is not supported' WHEN c_custkey % 9 = 0 THEN 'status is not supported'
  WHEN c_custkey % 4 = 3 THEN 'protection kind is not supported' WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN 'entity type is not supported'
  WHEN c_custkey % 6 = 1 THEN 'form must be value~kind~boundary' WHEN c_custkey % 4 <> 0 AND c_custkey % 6 = 0 THEN 'literal forms must use substring boundaries' END"""


@q("import_registry_rejects", f"SELECT c_custkey AS row, {_CSV_REASON} AS reason FROM {{customer}} WHERE {_CSV_REASON} IS NOT NULL")
def _(t):
    return S.check_import(t.sql(_CSV))[1].select("row", "reason")


@q("import_registry_entries", f"""SELECT c_custkey AS row, CASE WHEN c_custkey % 4 = 0 THEN 'entity' ELSE 'literal' END AS protection_kind, c_name AS value,
   CASE c_custkey % 5 WHEN 0 THEN 'client' WHEN 1 THEN 'other' ELSE 'vendor' END AS type, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS forms
   FROM {{customer}} WHERE {_CSV_REASON} IS NULL""")
def _(t):
    return S.check_import(t.sql(_CSV))[0].select("row", "protection_kind", "value", "type", F.size("forms").alias("forms"))


# ------------------------------------------------------------------------- S6 … S8, A8
def _bodies(t: Tables):
    path = F.expr("""CASE conv_id % 4 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/v1/chat/completions' WHEN 2 THEN '/v1/responses' ELSE '/v1/other' END""")
    turns = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    messages = F.transform("ts", lambda m: F.struct(m.role.alias("role"), m.text.alias("content")))
    return turns.select("conv_id", path.alias("path"), F.to_json(F.struct(
        F.concat(F.lit("m"), (F.col("conv_id") % 5).cast("string")).alias("model"), messages.alias("messages"),
        F.transform("ts", lambda m: F.struct(F.lit("function_call").alias("type"))).alias("input"),
        F.array(F.struct(F.lit(1).alias("x"))).alias("tools"))).alias("body"))


_WIRE = "CASE conv_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai-chat' WHEN 2 THEN 'openai-responses' ELSE 'unknown' END"


@q("read_bodies", f"SELECT DISTINCT conv_id, {_WIRE} AS wire, 'm' || CAST(conv_id % 5 AS VARCHAR) AS model FROM {{conversations}}")
def _(t):
    return S.read_bodies(_bodies(t)).select("conv_id", "wire", "model")


@q("flatten_leaves", """WITH n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM {conversations}),
   k AS (SELECT DISTINCT conv_id FROM {conversations})
   SELECT conv_id, '$.' || f AS path, 'key' AS kind, f AS text FROM k, (VALUES ('model'), ('messages'), ('input'), ('tools')) _f(f)
   UNION ALL SELECT conv_id, '$.model', 'value', 'm' || CAST(conv_id % 5 AS VARCHAR) FROM k
   UNION ALL SELECT conv_id, '$.tools[0].x', 'key', 'x' FROM k
   UNION ALL SELECT conv_id, '$.messages[' || CAST(i AS VARCHAR) || '].' || f, 'key', f FROM n, (VALUES ('role'), ('content')) _g(f)
   UNION ALL SELECT conv_id, '$.messages[' || CAST(i AS VARCHAR) || '].role', 'value', role FROM n
   UNION ALL SELECT conv_id, '$.messages[' || CAST(i AS VARCHAR) || '].content', 'value', text FROM n
   UNION ALL SELECT conv_id, '$.input[' || CAST(i AS VARCHAR) || '].type', 'key', 'type' FROM n
   UNION ALL SELECT conv_id, '$.input[' || CAST(i AS VARCHAR) || '].type', 'value', 'function_call' FROM n""")
def _(t):
    return S.flatten_leaves(_bodies(t), ["conv_id"], "body")


@q("flatten_event_props", """SELECT event_id, '$.k' AS path, 'key' AS kind, 'k' AS text FROM {events}""")
def _(t):
    return S.flatten_leaves(t.events, ["event_id"], "props")


@q("inspect_paths", """SELECT conv_id, '$.messages[' || CAST(i AS VARCHAR) || '].role' AS path, 'role-' || role AS names FROM (
   SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM {conversations}) _n WHERE role = 'assistant'""")
def _(t):
    reg = t.conversations.filter("role = 'assistant'").select(F.col("role").alias("value"), F.concat(F.lit("role-"), "role").alias("name")).distinct()
    return R.inspect_paths(S.flatten_leaves(_bodies(t), ["conv_id"], "body"), reg, ["conv_id"])


@q("request_meta", f"""SELECT conv_id, {_WIRE} AS wire, true AS model_set, 1 AS tool_count, CASE WHEN conv_id % 4 < 2 THEN count(*) END AS message_count,
   CASE WHEN conv_id % 4 < 2 THEN 0 END AS tool_result_count, CASE WHEN conv_id % 4 = 2 THEN count(*) END AS input_count,
   CASE WHEN conv_id % 4 = 2 THEN count(*) END AS function_call_count, CASE WHEN conv_id % 4 = 2 THEN 0 END AS function_output_count
   FROM {{conversations}} GROUP BY conv_id""")
def _(t):
    return MT.request_meta(S.read_bodies(_bodies(t)), ["conv_id"])


_RESP = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai-chat' ELSE 'openai-responses' END AS wire,
  event_id % 4 AS a, event_id % 3 AS b FROM {events}"""


@q("response_meta", f"""SELECT event_id, wire, CASE WHEN wire = 'anthropic' THEN a + 1 END AS content_count, CASE WHEN wire = 'anthropic' THEN a END AS text_blocks,
   CASE WHEN wire = 'anthropic' THEN 1 END AS tool_uses, CASE WHEN wire = 'openai-chat' THEN 1 END AS choice_count,
   CASE WHEN wire = 'openai-responses' THEN a + 1 END AS output_count, CASE WHEN wire = 'openai-responses' THEN 1 END AS function_calls FROM ({_RESP}) _r""")
def _(t):
    many = lambda kind, n: F.array_repeat(F.struct(F.lit(kind).alias("type")), n)
    body = F.when(F.col("wire") == "anthropic", F.to_json(F.struct(F.concat(many("text", F.col("a").cast("int")), many("tool_use", F.lit(1))).alias("content")))).when(
        F.col("wire") == "openai-chat", F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"))).alias("choices")))).otherwise(
        F.to_json(F.struct(F.concat(many("message", F.col("a").cast("int")), many("function_call", F.lit(1))).alias("output"))))
    return MT.response_meta(t.sql(_RESP).withColumn("body", body), ["event_id"])


def sse_streams(t: Tables):
    """One stream text per user: named JSON records in event order, closed by [DONE]."""
    rec = F.concat(
        F.lit("event: "), "event_type", F.lit('\ndata: {"type":"'), F.when(F.col("event_id") % 2 == 0, "response.output_text.delta")
        .otherwise("content_block_delta"), F.lit('",\ndata: "id":'), F.col("event_id").cast("string"), F.lit(',"delta":{"type":"input_json_delta"}}\n\n'))
    return t.events.groupBy("user_id").agg(F.concat(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("event_id", rec.alias("r")))), lambda x: x.r), ""), F.lit("data: [DONE]\n\n")).alias("stream"))


@q("parse_sse", """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS event, CAST(event_id AS BIGINT) AS id, false AS done
   FROM {events} UNION ALL SELECT user_id, count(*), NULL, NULL, true FROM {events} GROUP BY user_id""")
def _(t):
    rec = S.parse_sse(sse_streams(t), ["user_id"])
    return rec.select("user_id", "seq", "event", F.try_variant_get(F.try_parse_json("data"), "$.id", B).alias("id"), "done")


@q("sse_meta", """SELECT user_id, count(*) AS data_lines, count(DISTINCT event_id % 2) AS event_types, 0 AS tool_use_starts,
   count(*) FILTER (WHERE event_id % 2 = 1) AS input_json_deltas, 0 AS function_call_starts, 0 AS function_argument_deltas,
   count(*) FILTER (WHERE event_id % 2 = 0) AS text_deltas, 0 AS chat_tool_deltas FROM {events} GROUP BY user_id""")
def _(t):
    return MT.sse_meta(S.parse_sse(sse_streams(t), ["user_id"]), ["user_id"])


# --------------------------------------------------------------------------- F2, F3, X1 …
_RULES = """SELECT DISTINCT name, 'r' || CAST(k AS STRING) AS rule_id, plugin, trusted, CAST(k AS INT) AS rank FROM (
  SELECT name, event_id % 3 AS k, CASE event_id % 3 WHEN 0 THEN 'user-config' WHEN 1 THEN 'routing' ELSE 'other' END AS plugin, event_id % 3 < 2 AS trusted
  FROM (SELECT event_id, 'API_KEY_' || CAST(user_id AS STRING) AS name, user_id FROM {events}) x WHERE user_id % 4 = 0 OR event_id % 3 = 2) y"""


@q("apply_policy_kept", f"""SELECT event_id, name, source FROM ({ENV_TABLE}) v WHERE name NOT IN (SELECT name FROM ({_RULES}) r WHERE trusted)""")
def _(t):
    return R.apply_policy(t.sql(ENV_TABLE), t.sql(_RULES), ["event_id"])[0].select("event_id", "name", "source")


@q("apply_policy_excluded", f"""SELECT v.name, arg_min(v.source, v.event_id) AS source, any_value(r.plugin) AS plugin, any_value(r.rule_id) AS rule_id FROM ({ENV_TABLE}) v
   JOIN (SELECT name, arg_min(plugin, rank) AS plugin, arg_min(rule_id, rank) AS rule_id FROM ({_RULES}) r0 WHERE trusted GROUP BY name) r ON v.name = r.name GROUP BY v.name""")
def _(t):
    return R.apply_policy(t.sql(ENV_TABLE), t.sql(_RULES), ["event_id"])[1]


@q("excluded_by_source", f"""SELECT source, count(*) AS excluded FROM (SELECT v.name, arg_min(v.source, v.event_id) AS source FROM ({ENV_TABLE}) v
   WHERE v.name IN (SELECT name FROM ({_RULES}) r WHERE trusted) GROUP BY v.name) _x GROUP BY source""")
def _(t):
    return R.excluded_by_source(R.apply_policy(t.sql(ENV_TABLE), t.sql(_RULES), ["event_id"])[1])


_LISTS = "SELECT event_id, ' NAME_' || CAST(user_id AS STRING) || ', bad-' || CAST(event_id % 7 AS STRING) || ',,NAME_1' AS names FROM {events}"


@q("parse_exclusions", """SELECT DISTINCT name, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AS valid FROM (
   SELECT trim(unnest(string_split(' NAME_' || CAST(user_id AS VARCHAR) || ', bad-' || CAST(event_id % 7 AS VARCHAR) || ',,NAME_1', ','))) AS name FROM {events}) _n WHERE name <> ''""")
def _(t):
    return R.parse_exclusions(t.sql(_LISTS), "names")


@q("union_registries", f"""SELECT value, arg_min(name, o) AS name, arg_min(source_rank, o) AS source_rank FROM (
   SELECT value, name, 0 AS source_rank, '0' || name AS o FROM ({ENV_TABLE}) a WHERE source = 'env-file' UNION ALL
   SELECT value, name, 1, '1' || name FROM ({ENV_TABLE}) b WHERE source = 'process-env' UNION ALL
   SELECT value, name, 2, '2' || name FROM ({ENV_TABLE}) c WHERE source = 'secret-dump') _u GROUP BY value""")
def _(t):
    e = t.sql(ENV_TABLE)
    parts = [e.filter(F.col("source") == s).select("value", "name") for s in ("env-file", "process-env", "secret-dump")]
    return R.union_registries(parts).select("value", "name", "source_rank")


@q("longest_value_first", f"SELECT name, value FROM ({ENV_TABLE}) e ORDER BY length(value) DESC, name, value")
def _(t):
    return R.longest_value_first(t.sql(ENV_TABLE).select("name", "value"))


_VERSION = "SELECT CAST(c_custkey AS STRING) AS entity_id, c_name AS value, c_mktsegment AS name, 'a' AS source FROM {customer} WHERE c_custkey % 5 <> 0"
_NEXT = "SELECT CAST(c_custkey AS STRING) AS entity_id, c_name AS value, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_mktsegment END AS name, 'a' AS source FROM {customer} WHERE c_custkey % 11 <> 0"


@q("registry_diff", """SELECT CAST(c_custkey AS VARCHAR) AS entity_id, CASE WHEN c_custkey % 5 = 0 THEN 'register' WHEN c_custkey % 11 = 0 THEN 'removed_needs_restart'
   WHEN c_custkey % 7 = 0 THEN 'changed_needs_restart' ELSE 'unchanged' END AS action, c_custkey % 5 <> 0 AS active_before, true AS active_after
   FROM {customer} WHERE c_custkey % 5 <> 0 OR c_custkey % 11 <> 0""")
def _(t):
    return R.registry_diff(t.sql(_VERSION), t.sql(_NEXT))


@q("suggest_registry", """SELECT min(value) AS value, 'other' AS type, 'literal' AS protection_kind, 'suggested' AS source, 'suggested' AS status
   FROM (SELECT trim(s_name) AS value FROM {supplier} UNION ALL SELECT upper(c_name) FROM {customer}) _p
   WHERE lower(value) NOT IN (SELECT lower(c_name) FROM {customer} WHERE c_custkey % 2 = 0) GROUP BY lower(value)""")
def _(t):
    proposed = t.supplier.select(F.col("s_name").alias("value")).union(t.customer.select(F.upper("c_name")))
    return R.suggest_registry(proposed, t.customer.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("value")))


# ------------------------------------------------------------------------------ A9, X2
def _review(t: Tables):
    env = t.sql(ENV_TABLE).filter("value <> '' and name <> ''")
    names = R.parse_exclusions(t.sql(_LISTS), "names")
    return R.review_values(env, t.sql(_RULES), names, ["event_id"]), names


@q("review_candidates", f"""WITH env AS (SELECT * FROM ({ENV_TABLE}) e WHERE value <> '' AND name <> ''),
   ex AS (SELECT name, arg_min(plugin, rank) AS plugin FROM ({_RULES}) r WHERE trusted GROUP BY name)
   SELECT e.name, CASE WHEN max(ex.plugin) IS NULL THEN 'protected' WHEN max(ex.plugin) = 'user-config' THEN 'user-excluded' ELSE 'plugin-excluded' END AS state,
     CASE WHEN max(ex.plugin) IS NULL THEN count(DISTINCT e.source) ELSE 1 END AS sources FROM env e LEFT JOIN ex ON e.name = ex.name GROUP BY e.name
   UNION ALL SELECT DISTINCT name, 'stale-excluded', 0 FROM (SELECT 'NAME_' || CAST(user_id AS VARCHAR) AS name FROM events UNION ALL SELECT 'NAME_1') _s""")
def _(t):
    return _review(t)[0].select("name", "state", F.size("sources").alias("sources"))


@q("next_exclude_names")
def _(t):
    candidates, names = _review(t)
    return R.next_exclude_names(candidates, candidates.filter("selected"), names.filter("valid"))


# -------------------------------------------------------------------------------- J3, A15
_MENTION = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ACME' || CAST(user_id AS STRING) WHEN 1 THEN 'Twin' || CAST(user_id % 10 AS STRING)
  WHEN 2 THEN 'Nobody' ELSE 'Two Words' END AS value, CASE WHEN event_id % 5 = 0 THEN 'person' ELSE 'Organization' END AS rule,
  CASE WHEN event_id % 7 = 0 THEN 'probabilistic' ELSE 'high' END AS confidence FROM {events}"""
_ORGS = """SELECT 'a' || CAST(c_custkey AS STRING) AS entity_id, 'The Acme' || CAST(c_custkey AS STRING) || ' Holdings Ltd' AS value FROM {customer}
  UNION ALL SELECT 'b' || CAST(c_custkey AS STRING), 'Twin' || CAST(c_custkey % 10 AS STRING) || ' Corp' FROM {customer} WHERE c_custkey < 20"""


@q("link_entities", f"""SELECT m.event_id, CASE WHEN k.n = 1 THEN k.owner END AS linked_id, coalesce(k.n >= 2, false) AS ambiguous FROM ({_MENTION}) m
   LEFT JOIN (SELECT key, count(*) AS n, min(entity_id) AS owner FROM (SELECT DISTINCT entity_id,
     CASE WHEN starts_with(value, 'The ') THEN lower(string_split(value, ' ')[2]) ELSE lower(string_split(value, ' ')[1]) END AS key FROM ({_ORGS}) o) _d GROUP BY key) k
   ON k.key = lower(m.value) AND m.rule = 'Organization' AND m.confidence = 'high'""")
def _(t):
    orgs = t.sql(_ORGS).withColumn("protection_kind", F.lit("entity")).withColumn("entity_type", F.lit("organization"))
    return M.link_entities(t.sql(_MENTION), orgs).select("event_id", "linked_id", "ambiguous")


@q("ambiguity_diagnostics", f"""SELECT event_id, 2 AS start_pos, 9 AS end_pos, 2 AS candidate_count FROM ({_MENTION}) m
   WHERE event_id % 4 = 1 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 3 = 0""")
def _(t):
    orgs = t.sql(_ORGS).withColumn("protection_kind", F.lit("entity")).withColumn("entity_type", F.lit("organization"))
    linked = M.link_entities(t.sql(_MENTION), orgs).withColumn("entity_id", F.col("value")).withColumn("start", F.lit(2)).withColumn("end", F.lit(9))
    won = linked.withColumn("end", F.lit(5)).filter("event_id % 3 = 0")
    return M.ambiguity_diagnostics(linked, won, ["event_id"]).select(
        "event_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "candidate_count")


# ------------------------------------------------------------------------------------ R20
_CUR = """SELECT CAST(c_custkey AS STRING) AS id, c_name AS value, 'client' AS type, 'manual' AS source, CASE WHEN c_custkey % 3 = 0 THEN 'suggested' ELSE 'approved' END AS status,
  'u0' AS created_by, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'u0' END AS approved_by, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2024-01-01' END AS approved_at,
  '2024-01-01' AS updated_at FROM {customer} WHERE c_custkey % 4 > 0"""
_INC = """SELECT CAST(c_custkey AS STRING) AS id, upper(c_name) AS value, 'vendor' AS type, 'csv' AS source, CASE WHEN c_custkey % 5 = 0 THEN 'ignored' ELSE NULL END AS status
  FROM {customer} WHERE c_custkey % 2 = 0"""


@q("registry_upsert", """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN new THEN upper(c_name) ELSE c_name END AS value,
   CASE WHEN new AND c_custkey % 5 = 0 THEN 'ignored' WHEN new THEN 'approved' WHEN c_custkey % 3 = 0 THEN 'suggested' ELSE 'approved' END AS status,
   CASE WHEN old THEN 'u0' ELSE 'u1' END AS created_by,
   CASE WHEN new AND c_custkey % 5 = 0 THEN NULL WHEN new THEN CASE WHEN old AND c_custkey % 3 > 0 THEN 'u0' ELSE 'u1' END WHEN c_custkey % 3 = 0 THEN NULL ELSE 'u0' END AS approved_by,
   CASE WHEN new AND c_custkey % 5 = 0 THEN NULL WHEN new THEN CASE WHEN old AND c_custkey % 3 > 0 THEN '2024-01-01' ELSE '2024-06-01' END WHEN c_custkey % 3 = 0 THEN NULL ELSE '2024-01-01' END AS approved_at,
   CASE WHEN new THEN '2024-06-01' ELSE '2024-01-01' END AS updated_at
   FROM (SELECT *, c_custkey % 2 = 0 AS new, c_custkey % 4 > 0 AS old FROM {customer}) _c WHERE new OR old""")
def _(t):
    return R.registry_upsert(t.sql(_CUR), t.sql(_INC), "u1", F.lit("2024-06-01")).select(
        "id", "value", "status", "created_by", "approved_by", "approved_at", "updated_at")


