"""Queries of the streaming operators.

Each runs a bounded stream over files Spark derives from the given tables (``availableNow``) into
a memory table, so its result can be checked against the batch twin in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalog.base import KEY, Query, Tables, duck, sql_digest, sql_luhn, sql_pieces, sql_typed
from catalog.redaction import HEX_SQL, hex_values, sql_occurrences
from cloakwork.functions import fixed
from cloakwork.functions.surrogates import Surrogates
from cloakwork.operators import detect as D
from cloakwork.plans.redact import Redactor
from cloakwork.session import shared_folder
from cloakwork.streaming import restore as SR
from cloakwork.streaming import scopes as SS

QUERIES: list[Query] = []
SUR = Surrogates(KEY)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def q(name: str, sql: str | None = None):
    def add(run):
        QUERIES.append(Query(name, run, duck(sql) if sql else None))
        return run
    return add


def scratch(t: Tables) -> str:
    """Folder for stream inputs, below the shared folder."""
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


class Feed:
    """A stream whose input arrives in pieces, one run of the stream for each; its state goes on from run to run.

    A run takes its piece as one micro-batch of as many files as the writing had tasks, so neither
    writing nor reading hangs on one task.
    """

    def __init__(self, t: Tables, df: DataFrame, piece: Column, pieces: int) -> None:
        self.t, self.df, self.piece, self.pieces = t, df, piece, pieces
        self.path = f"{scratch(t)}/in"

    def run(self, start: Callable[[DataFrame], StreamingQuery]) -> None:
        """``start`` the stream for every piece, from the same checkpoint; each run ends with its input."""
        for i in range(self.pieces):
            self.df.filter(self.piece == i).write.mode("append").parquet(self.path)
            start(self.t.spark.readStream.schema(self.df.schema).parquet(self.path)).awaitTermination()


def as_batches(t: Tables, df: DataFrame, order: str, pieces: int = 3) -> Feed:
    """Micro-batches in the order of a column: state has to cross them."""
    most = df.agg(F.max(order).alias("m")).first()["m"] or 0
    return Feed(t, df, F.floor(F.col(order) * pieces / F.lit(most + 1)), pieces)


def as_stream(t: Tables, df: DataFrame, pieces: int = 2) -> Feed:
    """Micro-batches of any rows."""
    return Feed(t, df, F.pmod(F.xxhash64(*df.columns), F.lit(pieces)), pieces)


def drain(t: Tables, feed: Feed, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run to the end of the input, into files (append) or a memory table (update and complete)."""
    place, table, out = scratch(t), "stream_" + uuid.uuid4().hex, None

    def start(stream: DataFrame) -> StreamingQuery:
        nonlocal out
        out = plan(stream)
        writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/cp").trigger(availableNow=True)
        if mode == "append":
            return writer.format("parquet").option("path", f"{place}/out").start()
        return writer.format("memory").queryName(table).start()

    old = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        feed.run(start)
    finally:
        if old is None:
            t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    if mode == "append":
        return t.spark.read.schema(out.schema).parquet(f"{place}/out")
    return t.spark.table(table)


# ------------------------------------------------------------------------------ T1, T3, T6
# Each user's text holds one token, cut into chunks of seven characters.
_TOKEN = f"'{SUR.prefix}SECRET_' || {sql_digest(chr(39) + 'value-' + chr(39) + ' || CAST(user_id % 20 AS VARCHAR)')}"


def chunks(t: Tables) -> DataFrame:
    token = SUR.mint_typed(F.concat(F.lit("value-"), (F.col("user_id") % 20).cast("string")), F.lit("x"), F.lit("secret"))
    text = F.concat(F.lit("see "), token, F.lit(" now "), F.col("user_id").cast("string"), F.lit(" CLOAK"))
    users = t.events.select("user_id").distinct().select("user_id", text.alias("text"))
    n = F.ceil(F.length("text") / 7).cast("int")
    return users.select(F.col("user_id").cast("string").alias("stream_id"), F.posexplode(F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.substring(F.col("text"), i * 7 + 1, F.lit(7)).alias("text"), (i == n - 1).alias("last")))
    ).alias("seq", "c")).select("stream_id", F.col("seq").cast("bigint").alias("seq"), "c.text", "c.last")


def mapping(t: Tables) -> DataFrame:
    """What each stream may restore: its own value, and for odd streams a value that others own."""
    token = lambda v: SUR.mint_typed(v, F.lit("x"), F.lit("secret"))
    value = F.concat(F.lit("value-"), (F.col("user_id") % 20).cast("string"))
    return t.events.select("user_id").distinct().filter("user_id % 3 <> 0").select(
        F.col("user_id").cast("string").alias("stream_id"), token(value).alias("token"), value.alias("value"), F.lit("detected").alias("layer"), F.lit(1).alias("layer_rank"))


# every third stream owns no value: its token stays, though others could restore it
_RESTORED = f"""'see ' || CASE WHEN user_id % 3 = 0 THEN {_TOKEN} ELSE 'value-' || CAST(user_id % 20 AS VARCHAR) END || ' now ' || CAST(user_id AS VARCHAR) || ' CLOAK'"""


@q("stream_restore_chunks", f"""SELECT CAST(user_id AS VARCHAR) AS stream_id, {_RESTORED} AS text,
   CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS residuals FROM (SELECT DISTINCT user_id FROM {{events}}) _u""")
def _(t):
    # several micro-batches: tokens straddle them
    out = drain(t, as_batches(t, chunks(t), "seq"), lambda s: SR.restore_chunks(s, mapping(t), SUR))
    return out.groupBy("stream_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("text"), F.sum("residuals").alias("residuals"))


# ------------------------------------------------------------------------------------- T2
def sse_records(t: Tables) -> DataFrame:
    c = chunks(t)
    delta = F.concat(F.lit('{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"'), "text", F.lit('"}}'))
    stop = F.lit('{"type":"content_block_stop","index":0}')
    ends = c.filter("last").select("stream_id", (F.col("seq") + 1).alias("seq"), stop.alias("data"))
    return c.select("stream_id", "seq", delta.alias("data")).unionByName(ends)


@q("stream_whole_fragments", f"""SELECT CAST(user_id AS VARCHAR) AS stream_id, 'anthropic:0:text' AS fragment,
   'see ' || {_TOKEN} || ' now ' || CAST(user_id AS VARCHAR) || ' CLOAK' AS text, true AS token_whole FROM (SELECT DISTINCT user_id FROM {{events}}) _u""")
def _(t):
    out = drain(t, as_batches(t, sse_records(t), "seq"), lambda s: SR.whole_fragments(SR.record_fragments(s, F.lit("anthropic")), SUR))
    return out.groupBy("stream_id", "fragment").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("text"),
        F.bool_or(F.col("text").rlike(SUR.typed_pattern)).alias("token_whole"))


def _texts(out: DataFrame) -> DataFrame:
    return out.groupBy("stream_id", "fragment").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("text"),
        F.sum("withheld").alias("withheld"), F.sum("residuals").alias("residuals"))


@q("stream_restore_fragments", f"""SELECT CAST(user_id AS VARCHAR) AS stream_id, 'anthropic:0:text' AS fragment, {_RESTORED} AS text,
   CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS residuals FROM (SELECT DISTINCT user_id FROM {{events}}) _u""")
def _(t):
    # restored inside the stream: what reaches the sink is final
    out = drain(t, as_batches(t, sse_records(t), "seq"), lambda s: SR.restore_stream(
        SR.record_fragments(s, F.lit("anthropic")), mapping(t), SUR))
    return _texts(out).select("stream_id", "fragment", "text", "residuals")


# tool arguments and an answer side by side; every other value comes from the registry, and the
# dictionary of every fifth stream arrives inside the stream, ahead of its text
def tool_records(t: Tables) -> tuple[DataFrame, DataFrame]:
    value = F.concat(F.lit('p"'), F.col("user_id").cast("string"))
    token = SUR.mint_typed(value, F.lit("x"), F.lit("secret"))
    layer = F.when(F.col("user_id") % 2 == 0, "detected").otherwise("registry")
    users = t.events.select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("stream_id"), "user_id", token.alias("token"), value.alias("value"), layer.alias("layer"))
    rows = None
    for fragment, kind, text in (("args", "tool", F.concat(F.lit('{"a":"'), "token", F.lit('"}'))), ("say", "text", F.concat(F.lit("use "), "token"))):
        n = F.ceil(F.length("text") / 5).cast("int")
        cut = users.select("stream_id", text.alias("text")).select("stream_id", F.posexplode(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.substring(F.col("text"), i * 5 + 1, F.lit(5)).alias("text"), (i == n - 1).alias("stop")))).alias("seq", "c"))
        part = cut.select("stream_id", F.lit(fragment).alias("fragment"), (F.col("seq").cast("bigint") + 1).alias("seq"), F.lit(kind).alias("kind"), "c.text", "c.stop",
                          F.lit(None).cast("string").alias("layer"))
        rows = part if rows is None else rows.unionByName(part)
    late = users.filter("user_id % 5 = 0").select("stream_id", F.col("token").alias("fragment"), F.lit(0).cast("bigint").alias("seq"), F.lit("entry").alias("kind"),
                                                  F.col("value").alias("text"), F.lit(False).alias("stop"), "layer")
    return rows.unionByName(late), users.filter("user_id % 5 <> 0").select("stream_id", "token", "value", "layer")


_TOOL_TOKEN = f"'{SUR.prefix}SECRET_' || {sql_digest(chr(39) + 'p' + chr(34) + chr(39) + ' || CAST(user_id AS VARCHAR)')}"


@q("stream_restore_tools", f"""SELECT CAST(user_id AS VARCHAR) AS stream_id, 'args' AS fragment, CASE WHEN user_id % 2 = 0 THEN '{{"a":"p\\"' || CAST(user_id AS VARCHAR) || '"}}'
     ELSE '{{"a":"' || {_TOOL_TOKEN} || '"}}' END AS text, user_id % 2 AS withheld, 0 AS residuals FROM (SELECT DISTINCT user_id FROM {{events}}) _u
   UNION ALL SELECT CAST(user_id AS VARCHAR), 'say', 'use p"' || CAST(user_id AS VARCHAR), 0, 0 FROM (SELECT DISTINCT user_id FROM {{events}}) _v""")
def _(t):
    rows, dictionary = tool_records(t)
    return _texts(drain(t, as_batches(t, rows, "seq"), lambda s: SR.restore_stream(s, dictionary, SUR, "detected")))


@q("join_fragments_batch", f"""SELECT CAST(user_id AS VARCHAR) AS stream_id, 'anthropic:0:text' AS fragment, 'text' AS kind,
   'see ' || {_TOKEN} || ' now ' || CAST(user_id AS VARCHAR) || ' CLOAK' AS text FROM (SELECT DISTINCT user_id FROM {{events}}) _u""")
def _(t):
    return SR.joined_fragments(SR.record_fragments(sse_records(t), F.lit("anthropic")))


# --------------------------------------------------------------------------------- T4, T5
_SEEN = """SELECT CAST(user_id AS STRING) AS scope, event_id AS turn, event_type AS value FROM {events}"""


@q("stream_scope_memory", f"SELECT scope, value, min(turn) AS first_turn, 1 AS new_rows FROM ({_SEEN}) s GROUP BY scope, value")
def _(t):
    out = drain(t, as_batches(t, t.sql(_SEEN), "turn"), SS.scope_memory)
    return out.groupBy("scope", "value").agg(F.min("first_turn").alias("first_turn"), F.count_if("new").alias("new_rows"))


@q("stream_swept_once", "SELECT CAST(user_id AS VARCHAR) AS scope, event_type AS text FROM {events} GROUP BY user_id, event_type")
def _(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("text"))
    return drain(t, as_stream(t, rows), SS.swept_once).select("scope", "text")


@q("stream_detect", f"""SELECT doc_id, 'email' AS rule, value FROM {sql_pieces('documents', 'doc_id', 'text', fixed.EMAIL)} _e
   UNION ALL SELECT doc_id, 'us-ssn', value FROM {sql_pieces('documents', 'doc_id', 'text', fixed.US_SSN)} _s
   UNION ALL SELECT doc_id, 'credit-card', value FROM {sql_pieces('documents', 'doc_id', 'text', fixed.CREDIT_CARD)} _c WHERE {sql_luhn('value')}""")
def _(t):
    rows = t.documents.select("doc_id", "text")
    return drain(t, as_stream(t, rows), lambda s: SS.detect_stream(s, ["doc_id"], "text", D.PII_RULES)).select("doc_id", "rule", "value")


# --------------------------------------------------------------------------------- T7, T8
# Batch k has the k-th third of the documents.  The source lists one group of values per batch and
# forgets the groups before; those must stay active.
_GROUP = "CASE WHEN value < '5' THEN 0 WHEN value < 'a' THEN 1 ELSE 2 END"
_BATCH = "CAST(floor(doc_id * 3 / ((SELECT max(doc_id) FROM documents) + 1)) AS INT)"


@q("stream_live_registry", f"""SELECT d.doc_id, coalesce(r.redacted, d.text) AS redacted FROM documents d LEFT JOIN (
   SELECT doc_id, string_agg(substr(text, prev + 1, start_pos - prev) || token, '' ORDER BY start_pos) || substr(any_value(text), max(end_pos) + 1) AS redacted
   FROM (SELECT o.doc_id, d.text, start_pos, end_pos, {sql_typed('value', "'registry'", "'custom'")} AS token,
      coalesce(lag(end_pos) OVER (PARTITION BY o.doc_id ORDER BY start_pos), 0) AS prev
      FROM {sql_occurrences('documents', 'doc_id', HEX_SQL)} o JOIN (SELECT doc_id, text, {_BATCH} AS batch FROM documents) d USING (doc_id) WHERE {_GROUP} <= batch) _x
   GROUP BY doc_id) r USING (doc_id)""")
def _(t):
    place, asked = scratch(t), []
    values = hex_values(t)

    def listed() -> DataFrame:
        asked.append(None)
        return values.filter(F.expr(_GROUP) == len(asked) - 1)

    registry = SS.LiveRegistry(t.spark, place)
    handle = SS.with_live_registry(
        registry, listed, lambda f: Redactor(SUR, (), f), ["doc_id"], "text",
        lambda df, epoch: df.select("doc_id", "redacted").write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}"))
    as_batches(t, t.documents.select("doc_id", "text"), "doc_id").run(lambda s: s.writeStream.foreachBatch(handle).option(
        "checkpointLocation", f"{place}/cp").trigger(availableNow=True).start())
    return t.spark.read.parquet(f"{place}/out").select("doc_id", "redacted")


_STATS = """SELECT CASE event_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai-chat' ELSE 'unknown' END AS wire, event_type AS surface,
  event_id % 6 AS redacted_values, event_id % 3 AS surviving_values, event_id % 7 = 0 AS blocked FROM {events}"""


@q("stream_running_stats", f"""SELECT wire, surface, count(*) AS events, sum(redacted_values) AS redacted_values, sum(surviving_values) AS surviving_values,
   sum(redacted_values + CASE WHEN blocked THEN surviving_values ELSE 0 END) AS kept_out_values FROM ({_STATS}) s GROUP BY wire, surface""")
def _(t):
    return drain(t, as_stream(t, t.sql(_STATS)), SS.running_stats, "complete")
