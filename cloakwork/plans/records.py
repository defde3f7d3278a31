"""Conversation records: hash chains, snapshots, titles, retention."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cloakwork.functions import fixed
from cloakwork.functions.text import fold_ws


# ---------------------------------------------------------------------- W5, W6
def _chain_head(thread: Column, payload: Column) -> Column:
    """Canonical JSON of a link up to its previous hash."""
    doc = F.struct(F.lit(2).alias("version"), thread.alias("threadId"), payload.alias("event"))
    text = F.to_json(doc, {"ignoreNullFields": "false"})
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"previousHash":'))


def event_hash(thread: Column, payload: Column, previous: Column) -> Column:
    """Hash of one chain link: canonical JSON of version, thread, event payload and previous hash."""
    quoted = F.coalesce(F.concat(F.lit('"'), previous, F.lit('"')), F.lit("null"))
    return F.sha2(F.concat(_chain_head(thread, payload), quoted, F.lit("}")), 256)


def _fold_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Carry the last hash along rows sorted by thread and time; holds one batch at a time."""
    thread, last = None, None
    for batch in batches:
        before, after = [], []
        for key, head in zip(batch["_thread"], batch["_head"], strict=True):
            previous = last if key == thread else None
            tail = "null" if previous is None else f'"{previous}"'
            thread, last = key, hashlib.sha256(f"{head}{tail}}}".encode()).hexdigest()
            before.append(previous)
            after.append(last)
        yield batch.drop(columns=["_head", "_thread", "_id"]).assign(previous_hash=before, event_hash=after)


def hash_chain(events: DataFrame, thread: str, payload_cols: Sequence[str], at: str = "at",
               event_id: str = "event_id") -> DataFrame:
    """Chain the events of each thread; re-delivered events (same id) count once.

    A chain is sequential by definition.  Threads are spread over tasks, sorted on disk by Spark
    and streamed through a small hash fold, so no thread is ever held in memory as a whole.
    """
    cols = list(dict.fromkeys([event_id, at, *payload_cols]))
    once = events.groupBy(thread, event_id).agg(F.min(F.struct(*[c for c in cols if c != event_id])).alias("m"))
    rows = once.select(thread, event_id, *[F.col(f"m.{c}").alias(c) for c in cols if c != event_id])
    payload = F.struct(*cols)
    rows = rows.withColumn("_head", _chain_head(F.col(thread), payload)).withColumn(
        "_thread", F.col(thread).cast("string")).withColumn("_id", F.col(event_id).cast("string"))
    placed = rows.repartition(thread).sortWithinPartitions(thread, at, "_id")
    schema = T.StructType([f for f in rows.schema if not f.name.startswith("_")]).add(
        "previous_hash", "string").add("event_hash", "string")
    return placed.mapInPandas(_fold_links, schema)


def verify_chain(chained: DataFrame, thread: str, payload_cols: Sequence[str], at: str = "at",
                 event_id: str = "event_id") -> DataFrame:
    """Per event: is the stored previous hash the hash before it, and does the hash recompute."""
    w = W.partitionBy(thread).orderBy(at, F.col(event_id).cast("string"))
    payload = F.struct(*dict.fromkeys([event_id, at, *payload_cols]))
    return chained.withColumn("_before", F.lag("event_hash").over(w)).select(
        thread, event_id,
        F.col("previous_hash").eqNullSafe(F.col("_before")).alias("linked"),
        (F.col("event_hash") == event_hash(F.col(thread), payload, F.col("previous_hash"))).alias("intact"))


# ---------------------------------------------------------------------- W7, W8
def latest_snapshot(messages: DataFrame, thread: str, snapshot: str) -> DataFrame:
    """Messages of each thread's newest snapshot; what it no longer holds is gone."""
    last = messages.groupBy(thread).agg(F.max(snapshot).alias(snapshot))
    return messages.join(last, [thread, snapshot], "left_semi")


def merge_snapshots(stored: DataFrame, snapshots: DataFrame, thread: str, snapshot: str, message: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Apply transcript snapshots to stored messages; returns (messages, tombstones).

    The newest snapshot of a thread is the whole truth about it: its messages are stored under their
    ids with role, parts and ``order_index`` of the snapshot, what it lacks is gone.  ``created`` stays
    while a message is in every snapshot; one that was missing in between is new again from the
    snapshot that brought it back.  Threads without a snapshot keep their rows.  Tombstones name the
    stored messages that went and the snapshot that removed them.
    """
    numbers = W.partitionBy(thread).orderBy(snapshot)
    taken = snapshots.select(thread, snapshot).distinct().withColumn("_no", F.row_number().over(numbers)).withColumn(
        "_last", F.count("*").over(W.partitionBy(thread)))
    rows = snapshots.join(taken, [thread, snapshot])
    # snapshots without a gap in front of the newest one share the difference of number and rank
    run = F.col("_no") - F.row_number().over(W.partitionBy(thread, message).orderBy("_no"))
    run_of = W.partitionBy(thread, message, "_run")
    rows = rows.withColumn("_run", run).withColumn("_since", F.min("_no").over(run_of)).withColumn("_since_name", F.min(snapshot).over(run_of))
    newest = rows.filter("_no = _last").withColumn(
        "order_index", F.row_number().over(W.partitionBy(thread).orderBy(order)) - 1)
    before = stored.select(F.col(message), F.col("created").alias("_created"))
    # a message in all snapshots is as old as its stored row
    kept = newest.join(before, message, "left").select(
        thread, message, "role", "order_index", "parts", F.when((F.col("_since") == 1) & F.col("_created").isNotNull(), F.col("_created")).otherwise(
            F.col("_since_name")).alias("created"))
    threads = taken.filter("_no = _last").select(thread, F.col(snapshot).alias("removed"))
    untouched = stored.join(threads, thread, "left_anti").select(*kept.columns)
    gone = stored.join(threads, thread).join(newest.select(message), message, "left_anti").select(thread, message, "removed")
    return kept.unionByName(untouched), gone


def parts_text(parts: Column) -> Column:
    """Text of message parts ``array<struct<type,content,text>>``."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p.type == "text"),
                                    lambda p: F.coalesce(p.content, p.text, F.lit(""))), "")


def title_of(text: Column) -> Column:
    """Thread title: the user's request behind a context block, else the folded text."""
    marker = fixed.USER_REQUEST_MARKER
    pieces = F.split(text, marker, -1)
    request = F.get(pieces, F.size(pieces) - 1)
    closed_later = request.contains(fixed.FILE_CLOSE)
    asked = F.when((F.size(pieces) > 1) & ~closed_later, F.substring(fold_ws(request), 1, fixed.TITLE_MAX))
    plain = F.substring(fold_ws(text), 1, fixed.TITLE_MAX)
    return F.when(text.isNull() | (text == ""), fixed.DEFAULT_TITLE).when(
        F.coalesce(asked, F.lit("")) != "", asked).when(
        text.rlike(fixed.ATTACHED_PATTERN), fixed.ATTACHED_TITLE).when(plain != "", plain).otherwise(fixed.DEFAULT_TITLE)


def first_user_title(messages: DataFrame, thread: str, order: str, text: str = "text") -> DataFrame:
    """Title of each thread from its first user message."""
    first = messages.groupBy(thread).agg(
        F.min(F.when(F.col("role") == "user", F.struct(F.col(order), F.col(text).alias("t")))).alias("m"))
    return first.select(thread, title_of(F.col("m.t")).alias("title"))


# ------------------------------------------------------------- A10, J9, R19
def retained_threads(threads: DataFrame, messages: DataFrame, now: Column, thread: str = "thread_id") -> DataFrame:
    """Soft-deleted threads still within retention, with their message counts."""
    live = threads.filter(F.col("deleted_at").isNotNull() & (F.col("purge_after") > now))
    counts = messages.groupBy(thread).agg(F.count("*").alias("message_count"))
    return live.join(counts, thread, "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def prune_abandoned(values: DataFrame, threads: DataFrame, now: Column, thread: str = "thread_id") -> tuple[DataFrame, DataFrame]:
    """(kept, pruned) scoped values; abandoned ones are old and have no thread."""
    old = F.col("created_at") < now - F.expr(f"INTERVAL {fixed.ABANDONED_HOURS} HOURS")
    known = threads.select(thread, F.lit(True).alias("_has")).distinct()
    marked = values.join(known, thread, "left").withColumn("_prune", old & F.col("_has").isNull())
    return marked.filter(~F.col("_prune")).drop("_has", "_prune"), marked.filter("_prune").drop("_has", "_prune")


def retention_sweep(threads: DataFrame, values: DataFrame, audit: DataFrame, egress: DataFrame, settings: DataFrame,
                    now: Column, org: str = "org_id", thread: str = "thread_id") -> dict[str, DataFrame]:
    """Purge due threads with their values, record each purge, age out audit and egress rows.

    Returns the tables after the sweep and a ``report`` of counts per organization.
    """
    due = F.col("deleted_at").isNotNull() & (F.col("purge_after") <= now)
    in_scope = threads.join(settings.select(org), org, "left_semi")
    purged = in_scope.filter(due)
    gone = purged.select(thread)
    purge_rows = purged.select(org, thread, F.lit("purged").alias("action"), now.alias("occurred_at"),
                               F.lit("system:retention").alias("actor"))
    audit_all = audit.unionByName(purge_rows, allowMissingColumns=True)
    days = settings.select(org, F.col("audit_days"))
    # without a setting nothing ages out
    aged = F.col("audit_days").isNotNull() & (
        F.col("occurred_at") < now - F.make_dt_interval(F.coalesce("audit_days", F.lit(0)).cast("int")))
    old_audit = audit_all.join(days, org, "left").withColumn("_old", F.coalesce(aged, F.lit(False)))
    old_egress = egress.join(days, org, "left").withColumn("_old", F.coalesce(aged, F.lit(False)))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(org).agg(F.count("*").alias(name))

    report = settings.select(org)
    for part in (counted(purged, "purged_threads"), counted(old_audit.filter("_old"), "purged_audit_events"),
                 counted(old_egress.filter("_old"), "purged_egress_events")):
        report = report.join(part, org, "left")
    return {
        "threads": threads.join(gone, thread, "left_anti"),
        "values": values.join(gone, thread, "left_anti"),
        "audit": old_audit.filter(~F.col("_old")).drop("_old", "audit_days"),
        "egress": old_egress.filter(~F.col("_old")).drop("_old", "audit_days"),
        "report": report.fillna(0),
    }
