"""Queries of statistics, records, quality and fidelity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, PROTECTION_EVENTS, Query, Tables, duck
from cloakwork.functions.surrogates import Surrogates
from cloakwork.functions.text import retention_cutoff, utc_day
from cloakwork.plans import quality as Q
from cloakwork.plans import records as RC
from cloakwork.plans import stats as ST

QUERIES: list[Query] = []
B = "bigint"
SUR = Surrogates(KEY)


def q(name: str, sql: str | None = None):
    def add(run):
        QUERIES.append(Query(name, run, duck(sql) if sql else None))
        return run
    return add


_EV = f"({PROTECTION_EVENTS}) e"
_MODEL = ("CASE WHEN trim(model) = '' THEN 'unknown' WHEN length(trim(model)) > 160 THEN substr(trim(model), 1, 157) || '…' "
          "ELSE trim(model) END")
_KEPT = "(redacted_values > 0 OR surviving_values > 0 OR ambiguous_links > 0 OR block_reason IS NOT NULL)"
_K = "coalesce('request:' || request_id, 'event:' || CAST(event_index AS VARCHAR))"
_OUT = "redacted_values + CASE WHEN blocked THEN surviving_values ELSE 0 END"


def events(t: Tables):
    return ST.event_filter(t.sql(PROTECTION_EVENTS))


def with_hits(t: Tables):
    hit = lambda n, kind: F.struct(F.lit(n).alias("name"), F.lit("src").alias("source"), F.lit("p").alias("plugin"),
                                   F.lit(kind).alias("kind"), F.lit("high").alias("confidence"))
    return events(t).withColumn("redacted_hits", F.concat(
        F.array_repeat(hit("email", "pii"), (F.col("redacted_values") / 2).cast("int")),
        F.array_repeat(hit("jwt", "secret"), (F.col("redacted_values") - (F.col("redacted_values") / 2).cast("int")).cast("int")))
    ).withColumn("surviving_hits", F.array_repeat(hit("email", "pii"), F.col("surviving_values").cast("int")))


@q("event_filter", f"SELECT event_index, {_MODEL} AS model FROM {_EV} WHERE {_KEPT}")
def _(t):
    return events(t).select("event_index", "model")


@q("stats_totals", f"""SELECT count(*) AS events, count(DISTINCT {_K}) AS affected_requests, sum(redacted_values) AS redacted_values,
   sum(surviving_values) AS surviving_values, count(DISTINCT CASE WHEN blocked THEN {_K} END) AS blocked_requests, sum({_OUT}) AS kept_out_values,
   sum(ambiguous_links) AS ambiguous_links, count(DISTINCT CASE WHEN ambiguous_links > 0 THEN {_K} END) AS ambiguous_requests FROM {_EV} WHERE {_KEPT}""")
def _(t):
    return ST.stats_totals(events(t))


_BY = " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, {x} AS name, count(DISTINCT {_K}) AS requests, sum(redacted_values) AS redacted_values, sum(surviving_values) AS surviving_values,
    count(DISTINCT CASE WHEN blocked THEN {_K} END) AS blocked_requests, sum({_OUT}) AS kept_out_values FROM {_EV} WHERE {_KEPT} GROUP BY {x}"""
    for d, x in (("model", _MODEL), ("surface", "surface"), ("wire", "wire")))


@q("stats_by_dimension", _BY)
def _(t):
    return ST.stats_by(events(t))


@q("top_buckets", f"""SELECT dimension, name, kept_out_values, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension
   ORDER BY kept_out_values DESC, redacted_values DESC, name) AS rank FROM ({_BY}) _b) _r WHERE rank <= 3""")
def _(t):
    return ST.top_buckets(ST.stats_by(events(t))).select("dimension", "name", "kept_out_values", "rank")


@q("stats_by_label", f"""WITH h AS (SELECT {_K} AS k, blocked, redacted_values // 2 AS e, redacted_values - redacted_values // 2 AS j, surviving_values AS s FROM {_EV} WHERE {_KEPT})
   SELECT 'email' AS name, 'pii' AS kind, count(DISTINCT CASE WHEN e + s > 0 THEN k END) AS requests, sum(e) AS redacted_values, sum(s) AS surviving_values,
     count(DISTINCT CASE WHEN blocked AND s > 0 THEN k END) AS blocked_requests, sum(e + CASE WHEN blocked THEN s ELSE 0 END) AS kept_out_values FROM h
   UNION ALL SELECT 'jwt', 'secret', count(DISTINCT CASE WHEN j > 0 THEN k END), sum(j), 0, 0, sum(j) FROM h""")
def _(t):
    return ST.stats_by_label(with_hits(t)).drop("source", "plugin", "confidence")


@q("newest_events", f"SELECT event_index FROM {_EV} WHERE {_KEPT} ORDER BY event_index DESC LIMIT 100")
def _(t):
    return ST.newest_events(events(t), ST.event_limit("100")).select("event_index")


@q("safe_label", f"""SELECT event_index, CASE WHEN trim(model) = '' OR contains(model, 'click') OR regexp_matches(model, 'm{{10}}') THEN '<redacted>' ELSE trim(model) END AS label FROM {_EV}""")
def _(t):
    return t.sql(PROTECTION_EVENTS).select("event_index", ST.safe_label(
        F.col("model"), F.col("model").contains("click"), "m{10}", "<redacted>").alias("label"))


@q("egress_proofs", f"""SELECT org_id, thread_id, sum(redacted_values) AS redacted_values, sum(surviving_values) AS surviving_values,
   CASE WHEN bool_or(block_reason IS NOT NULL) THEN 'detector_unavailable' ELSE 'completed' END AS screening,
   CASE WHEN bool_or(blocked) THEN 'blocked' ELSE 'forwarded' END AS outcome,
   CAST(max(CASE WHEN redacted_values // 2 + surviving_values > 0 THEN 1 ELSE 0 END) + max(CASE WHEN redacted_values - redacted_values // 2 > 0 THEN 1 ELSE 0 END) AS INT) AS labels
   FROM {_EV} WHERE {_KEPT} GROUP BY org_id, thread_id""")
def _(t):
    rows = with_hits(t).withColumn("detector_unavailable", F.col("block_reason").isNotNull()).withColumn(
        "protected", F.lit(True)).withColumn("upstream_error", F.lit(False))
    return ST.egress_proofs(rows, "org_id", "thread_id").select(
        "org_id", "thread_id", "redacted_values", "surviving_values", "screening", "outcome",
        F.coalesce(F.size("labels"), F.lit(0)).alias("labels"))


# ------------------------------------------------------------------------- W5, W6, A6
_EGRESS = """SELECT CAST(user_id % 40 AS STRING) AS thread_id, CAST(event_id AS STRING) AS event_id, event_id AS at,
  CASE event_id % 3 WHEN 0 THEN 'blocked' ELSE 'forwarded' END AS outcome, event_id % 5 AS redacted_values, event_id % 2 AS surviving_values,
  event_id % 4 AS ambiguous_links FROM {events}"""
_PAYLOAD = ["outcome", "redacted_values", "surviving_values", "ambiguous_links"]
_LINK = ("'{\"version\":2,\"threadId\":\"' || thread_id || '\",\"event\":{\"event_id\":\"' || event_id || '\",\"at\":' || CAST(\"at\" AS VARCHAR) || ',\"outcome\":\"' || outcome"
         " || '\",\"redacted_values\":' || CAST(redacted_values AS VARCHAR) || ',\"surviving_values\":' || CAST(surviving_values AS VARCHAR) || ',\"ambiguous_links\":'"
         " || CAST(ambiguous_links AS VARCHAR) || '},\"previousHash\":'")
_CHAIN = f"""WITH RECURSIVE e AS (SELECT *, {_LINK} AS head, row_number() OVER (PARTITION BY thread_id ORDER BY \"at\", event_id) AS n FROM ({duck(_EGRESS).replace(" AS at,", " AS \"at\",")}) _e),
   c AS (SELECT thread_id, event_id, n, CAST(NULL AS VARCHAR) AS previous_hash, sha256(head || 'null}}') AS event_hash FROM e WHERE n = 1
     UNION ALL SELECT e.thread_id, e.event_id, e.n, c.event_hash, sha256(e.head || '"' || c.event_hash || '"}}') FROM c JOIN e ON e.thread_id = c.thread_id AND e.n = c.n + 1)"""


def chained(t: Tables):
    twice = t.sql(_EGRESS).unionByName(t.sql(_EGRESS).filter("at % 10 = 0"))
    return RC.hash_chain(twice, "thread_id", _PAYLOAD)


@q("hash_chain", f"{_CHAIN} SELECT thread_id, event_id, previous_hash, event_hash FROM c")
def _(t):
    return chained(t).select("thread_id", "event_id", "previous_hash", "event_hash")


@q("verify_chain", "SELECT count(*) AS n, count(*) AS intact, count(*) AS linked FROM {events}")
def _(t):
    ok = RC.verify_chain(chained(t), "thread_id", _PAYLOAD)
    return ok.agg(F.count("*").alias("n"), F.count_if("intact").alias("intact"), F.count_if("linked").alias("linked"))


@q("thread_receipt", f"""{_CHAIN} SELECT c.thread_id, count(*) AS events, count(*) FILTER (WHERE outcome = 'forwarded') AS forwarded_requests,
   count(*) FILTER (WHERE outcome = 'blocked') AS blocked_requests, sum(redacted_values) AS tokenized_values, sum(surviving_values) AS surviving_values,
   sum(ambiguous_links) AS ambiguous_links, arg_max(event_hash, c.n) AS chain_root FROM c JOIN e USING (thread_id, event_id) GROUP BY c.thread_id""")
def _(t):
    return ST.thread_receipt(chained(t))


# -------------------------------------------------------------------------------- A7
_SNAP = """SELECT CAST(user_id % 5 AS STRING) AS org_id, user_id AS run, ts AS updated_at, event_id % 40 AS events, event_id * 7 % 100 AS redacted_values FROM {events}"""


@q("daily_stats", f"""SELECT org_id, strftime(day, '%Y-%m-%d') AS day, sum(e) AS events, sum(r) AS redacted_values FROM (SELECT org_id, CAST(updated_at AS DATE) AS day,
   greatest(0, events - coalesce(lag(events) OVER w, 0)) AS e, greatest(0, redacted_values - coalesce(lag(redacted_values) OVER w, 0)) AS r
   FROM ({_SNAP}) _s WINDOW w AS (PARTITION BY org_id, run ORDER BY updated_at)) _d
   WHERE day >= DATE '2024-01-30' - 9 GROUP BY org_id, day HAVING sum(e) + sum(r) > 0""")
def _(t):
    daily = ST.daily_stats(t.sql(_SNAP), ["run"], ["events", "redacted_values"])
    kept = daily.filter(F.col("day") >= retention_cutoff(F.lit("2024-01-30").cast("date"), 10))
    return kept.select("org_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "events", "redacted_values")


@q("utc_day", "SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM {events}")
def _(t):
    return t.events.select("event_id", F.date_format(utc_day(F.col("ts")), "yyyy-MM-dd").alias("day"))


# --------------------------------------------------------------------- W7, W8, A10, J9
_SNAPS = "SELECT conv_id, turn, role, text, turn % 3 AS snap FROM {conversations}"


@q("latest_snapshot", f"SELECT conv_id, turn, snap FROM ({_SNAPS}) s QUALIFY snap = max(snap) OVER (PARTITION BY conv_id)")
def _(t):
    return RC.latest_snapshot(t.sql(_SNAPS), "conv_id", "snap").select("conv_id", "turn", "snap")


# Snapshot 0 lacks the third message, snapshot 1 the second and orders backwards, snapshot 2 has all but the
# last of long threads; odd threads stop at snapshot 1, every fifth thread has no snapshot at all.
_SAVED = """SELECT conv_id, s AS snap, conv_id * 1000 + turn AS message_id, role, CASE WHEN s = 1 THEN 100 - turn ELSE turn END AS pos, text || ' v' || CAST(s AS STRING) AS parts
  FROM {conversations} CROSS JOIN (SELECT explode(array(0, 1, 2)) AS s) v WHERE conv_id % 5 <> 4 AND (s < 2 OR conv_id % 2 = 0)
  AND NOT (s = 0 AND turn = 2) AND NOT (s = 1 AND turn = 1) AND NOT (s = 2 AND turn >= 4)"""
_HELD = """SELECT conv_id, conv_id * 1000 + turn AS message_id, role, turn AS order_index, text AS parts, -1 AS created FROM {conversations} WHERE turn < 6"""


@q("merge_snapshots", f"""WITH s AS (SELECT *, max(snap) OVER (PARTITION BY conv_id) AS newest FROM ({_SAVED.replace('(SELECT explode(array(0, 1, 2)) AS s) v', '(VALUES (0), (1), (2)) v(s)').replace('AS STRING', 'AS VARCHAR')}) _a),
   h AS ({_HELD})
   SELECT s.conv_id, s.message_id, s.role, CAST(row_number() OVER (PARTITION BY s.conv_id ORDER BY pos) - 1 AS BIGINT) AS order_index, s.parts,
     -- kept since the store, or since the snapshot after the last one without it
     coalesce((SELECT max(a.snap) + 1 FROM (SELECT DISTINCT conv_id, snap FROM s) a WHERE a.conv_id = s.conv_id AND NOT EXISTS (
        SELECT 1 FROM s b WHERE b.conv_id = a.conv_id AND b.snap = a.snap AND b.message_id = s.message_id)), h.created, 0) AS created
   FROM s LEFT JOIN h USING (message_id) WHERE snap = newest
   UNION ALL SELECT conv_id, message_id, role, order_index, parts, created FROM h WHERE conv_id % 5 = 4""")
def _(t):
    kept, _gone = RC.merge_snapshots(t.sql(_HELD), t.sql(_SAVED), "conv_id", "snap", "message_id", "pos")
    return kept.select("conv_id", "message_id", "role", F.col("order_index").cast("bigint").alias("order_index"), "parts", F.col("created").cast("bigint").alias("created"))


@q("snapshot_tombstones", f"""SELECT conv_id, message_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS removed FROM ({_HELD}) _h WHERE conv_id % 5 <> 4
   AND CASE WHEN conv_id % 2 = 0 THEN message_id % 1000 >= 4 ELSE message_id % 1000 = 1 END""")
def _(t):
    _kept, gone = RC.merge_snapshots(t.sql(_HELD), t.sql(_SAVED), "conv_id", "snap", "message_id", "pos")
    return gone.select("conv_id", "message_id", "removed")


_MSG = """SELECT conv_id, turn, role, CASE conv_id % 5 WHEN 0 THEN 'ctx <file_content>x</file_content>' || chr(10) || chr(10) || 'User request:' || chr(10) || '  sum   this ' || CAST(conv_id AS STRING)
  WHEN 1 THEN 'Attached text file 1 (filename omitted for privacy, 3 KB):' || chr(10) || '<file_content>' || text WHEN 2 THEN '  ' ELSE text END AS text FROM {conversations}"""


@q("first_user_title", f"""SELECT conv_id, CASE WHEN text IS NULL THEN 'New chat' ELSE CASE conv_id % 5 WHEN 0 THEN 'sum this ' || CAST(conv_id AS VARCHAR) WHEN 1 THEN 'Review Attached Text File' WHEN 2 THEN 'New chat'
   ELSE substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) END END AS title FROM (
   SELECT c.conv_id, arg_min(m.text, m.turn) AS text FROM (SELECT DISTINCT conv_id FROM {{conversations}}) c LEFT JOIN (SELECT * FROM ({_MSG}) _m WHERE role = 'user') m ON c.conv_id = m.conv_id GROUP BY c.conv_id) _t""")
def _(t):
    return RC.first_user_title(t.sql(_MSG), "conv_id", "turn")


_THREADS = """SELECT o_orderkey AS thread_id, CAST(o_custkey % 7 AS STRING) AS org_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS deleted_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS purge_after FROM {orders}"""
_NOW = "TIMESTAMP '1998-06-01 00:00:00'"


@q("retained_threads", f"""SELECT thread_id, coalesce(n, 0) AS message_count FROM ({_THREADS}) t LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {{lineitem}} GROUP BY l_orderkey) m
   ON m.l_orderkey = t.thread_id WHERE deleted_at IS NOT NULL AND purge_after > {_NOW}""")
def _(t):
    messages = t.lineitem.select(F.col("l_orderkey").alias("thread_id"))
    return RC.retained_threads(t.sql(_THREADS), messages, F.expr(_NOW)).select("thread_id", "message_count")


_VALUES = "SELECT l_orderkey * 2 AS thread_id, l_linenumber AS n, l_shipdate AS created_at FROM {lineitem}"


@q("prune_abandoned", f"""SELECT thread_id, n FROM ({_VALUES}) v WHERE created_at < {_NOW} - INTERVAL 24 HOUR AND thread_id NOT IN (SELECT o_orderkey FROM {{orders}})""")
def _(t):
    return RC.prune_abandoned(t.sql(_VALUES), t.sql(_THREADS), F.expr(_NOW))[1].select("thread_id", "n")


@q("retention_sweep", f"""WITH t AS ({_THREADS}), s AS (SELECT CAST(n_nationkey AS VARCHAR) AS org_id, CASE WHEN n_nationkey % 2 = 0 THEN 30 END AS d FROM {{nation}} WHERE n_nationkey < 7),
   p AS (SELECT org_id, count(*) AS n FROM t WHERE deleted_at IS NOT NULL AND purge_after <= {_NOW} GROUP BY org_id),
   a AS (SELECT CAST(user_id % 7 AS VARCHAR) AS org_id, {_NOW} - to_days(CAST(event_id % 60 AS INT)) AS occurred_at FROM {{events}}),
   g AS (SELECT a.org_id, count(*) AS n FROM a JOIN s USING (org_id) WHERE d IS NOT NULL AND occurred_at < {_NOW} - to_days(CAST(d AS INT)) GROUP BY a.org_id)
   SELECT s.org_id, coalesce(p.n, 0) AS purged_threads, coalesce(g.n, 0) AS purged_audit_events, coalesce(g.n, 0) AS purged_egress_events
   FROM s LEFT JOIN p USING (org_id) LEFT JOIN g USING (org_id)""")
def _(t):
    now = F.expr(_NOW)
    settings = t.nation.filter("n_nationkey < 7").select(F.col("n_nationkey").cast("string").alias("org_id"),
                                                         F.when(F.col("n_nationkey") % 2 == 0, 30).alias("audit_days"))
    log = t.events.select((F.col("user_id") % 7).cast("string").alias("org_id"), F.col("event_id").alias("thread_id"), F.lit("viewed").alias("action"),
                          (now - F.make_dt_interval((F.col("event_id") % 60).cast("int"))).alias("occurred_at"), F.lit("u").alias("actor"))
    values = t.sql(_VALUES).select("thread_id", "n")
    return RC.retention_sweep(t.sql(_THREADS), values, log, log, settings, now)["report"]


# -------------------------------------------------------------------------- A11 … A14
_EXPECT = "SELECT doc_id % 30 AS doc, 'E' || CAST(doc_id % 3 AS STRING) AS entity, doc_id * 3 % 4000 AS s, doc_id * 3 % 4000 + 8 AS e FROM {documents}"
_FIND = """SELECT 'old' AS detector, doc_id % 30 AS doc, 'E' || CAST(doc_id % 3 AS STRING) AS entity, doc_id * 3 % 4000 AS s, doc_id * 3 % 4000 + 8 AS e FROM {documents} WHERE doc_id % 4 < 2
  UNION ALL SELECT 'new', doc_id % 30, 'E' || CAST(doc_id % 3 AS STRING), doc_id * 3 % 4000 - 1, doc_id * 3 % 4000 + 9 FROM {documents} WHERE doc_id % 4 < 3"""
_CTRL = "SELECT doc_id % 30 AS doc, 'c' || CAST(doc_id AS STRING) AS value, doc_id * 5 % 4000 AS s, doc_id * 5 % 4000 + 2 AS e FROM {documents}"
_QUALITY = f"""WITH x AS (SELECT 'old' AS detector, * FROM ({_EXPECT}) a UNION ALL SELECT 'new', * FROM ({_EXPECT}) b), f AS ({_FIND}),
   c AS (SELECT 'old' AS detector, * FROM ({_CTRL}) a UNION ALL SELECT 'new', * FROM ({_CTRL}) b),
   r AS (SELECT detector, count(*) AS expected, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM f WHERE f.detector = x.detector AND f.doc = x.doc AND f.entity = x.entity AND f.s <= x.s AND f.e >= x.e)) AS detected FROM x GROUP BY detector),
   k AS (SELECT detector, count(*) AS controls, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.detector = c.detector AND f.doc = c.doc AND f.s < c.e AND c.s < f.e)) AS rejected FROM c GROUP BY detector),
   q AS (SELECT detector, expected, detected, controls, rejected, detected / expected AS identity_recall, rejected / controls AS control_rejection FROM r JOIN k USING (detector))"""


def quality(t: Tables):
    def spans(sql, both=True):
        d = t.sql(sql).withColumnsRenamed({"s": "start", "e": "end"})
        return d.withColumn("detector", F.explode(F.array(F.lit("old"), F.lit("new")))) if both else d
    return Q.detector_quality(spans(_EXPECT), spans(_CTRL), spans(_FIND, False), ["doc"])


@q("detector_quality", f"{duck(_QUALITY)} SELECT detector, expected, detected, controls, rejected, round(identity_recall, 9) AS identity_recall, round(control_rejection, 9) AS control_rejection FROM q")
def _(t):
    return quality(t).withColumn("identity_recall", F.round("identity_recall", 9)).withColumn("control_rejection", F.round("control_rejection", 9))


@q("keep_new_detector", f"""{duck(_QUALITY)} SELECT CASE WHEN n.identity_recall >= o.identity_recall + 0.02 AND n.control_rejection >= o.control_rejection + 0.02 THEN 'new' ELSE 'old' END AS recommendation
   FROM q n, q o WHERE n.detector = 'new' AND o.detector = 'old'""")
def _(t):
    return Q.keep_new(quality(t), "old", "new").select("recommendation")


_FID = """SELECT event_id, event_id % 4 AS m, SHA[CAST(event_id AS STRING)]SHA AS h FROM {events}"""


def fidelity(t: Tables):
    """Responses that list two tokens; every fourth one mutates, drops or negates something."""
    tok = lambda i: F.concat(F.lit(f"{SUR.prefix}SECRET_"), F.substring("h", i, 32))
    bad = F.concat(F.lit(f"{SUR.prefix}SECRET_"), F.substring("h", 5, 32))
    second = F.when(F.col("m") == 1, bad).otherwise(tok(2))
    return t.sql(_FID).select(
        "event_id", F.array(tok(1), tok(2)).alias("expected_tokens"), F.array(tok(1), second).alias("listed_tokens"),
        F.concat(tok(1), F.lit(" and "), second).alias("response"),
        F.when(F.col("m") == 1, F.concat(F.lit("a and "), bad)).otherwise("a and b").alias("restored"),
        F.array(F.struct(tok(1).alias("answer"), tok(1).alias("expected"), F.lit("e1").alias("answer_entity"), F.lit("e1").alias("expected_entity")),
                F.struct(second.alias("answer"), tok(2).alias("expected"), F.when(F.col("m") == 1, F.lit(None)).otherwise("e2").alias("answer_entity"),
                         F.lit("e2").alias("expected_entity"))).alias("parties"),
        F.array(F.struct(F.when(F.col("m") == 2, "not 30 Calendar days").when(F.col("m") == 3, "130 calendar  days, then 30 calendar days.")
                         .otherwise("within 30  calendar days.").alias("answer"), F.lit("30 calendar days").alias("expected"))).alias("facts"))


@q("surrogate_fidelity", """SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 0.5 ELSE 1.0 END AS token_recall, CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS mutations,
   CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS residuals, CASE WHEN event_id % 4 = 1 THEN 0.5 ELSE 1.0 END AS exact_parties,
   CASE WHEN event_id % 4 = 1 THEN 0.5 ELSE 1.0 END AS attribution, CASE WHEN event_id % 4 = 2 THEN 0.0 ELSE 1.0 END AS facts FROM {events}""")
def _(t):
    return Q.surrogate_fidelity(fidelity(t), ["event_id"], SUR.typed_pattern)


@q("fidelity_gate", """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 4 = 2 THEN 'facts must equal 1' ELSE
   'exact_parties must equal 1; attribution must equal 1; token_recall must equal 1; mutations must equal 0; residuals must equal 0' END AS reasons
   FROM {events} WHERE event_id % 4 IN (1, 2)""")
def _(t):
    gate = Q.fidelity_gate(Q.surrogate_fidelity(fidelity(t), ["event_id"], SUR.typed_pattern), ["event_id"])
    return gate.select("event_id", F.array_join("reasons", "; ").alias("reasons"))


@q("characterize_render", """SELECT c_custkey AS doc, 2 AS distinct_tokens, true AS surfaces_absent, true AS exact_round_trip, true AS one_tag_per_entity,
   true AS one_tag_per_surface FROM {customer}""")
def _(t):
    ctx, ent = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    surf = F.explode(F.array(F.col("c_name"), F.concat(F.lit("Cust "), "c_name")))
    m = t.customer.select(F.col("c_custkey").alias("doc"), "c_mktsegment", "c_custkey", surf.alias("surface")).select(
        "doc", "surface", ent.alias("entity_id"), SUR.mint_entity(ctx, ent, F.lit("organization"), F.col("surface")).alias("token"),
        SUR.entity_tag(ctx, ent).alias("entity_tag"), SUR.surface_tag(ctx, ent, F.col("surface")).alias("surface_tag"))
    texts = m.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list("surface")), " | ").alias("source"),
                                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("surface", "token"))), lambda x: x.token), " | ").alias("rendered"),
                                 F.map_from_entries(F.collect_list(F.struct("token", F.struct(F.col("surface").alias("value"), F.lit("registry").alias("layer"))))).alias("map"))
    from cloakwork.plans.restore import restore_column
    rendered = texts.select("doc", "source", "rendered", restore_column(F.col("rendered"), F.col("map"), SUR).alias("restored"))
    return Q.characterize_render(rendered, m, ["doc"])
