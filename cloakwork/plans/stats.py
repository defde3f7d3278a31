"""Protection accounting: totals, buckets, labels, proofs, receipts and daily deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloakwork.functions import fixed
from cloakwork.functions.text import retention_cutoff

HIT = "struct<name:string,source:string,plugin:string,kind:string,confidence:string>"
TOTALS = ["events", "affected_requests", "redacted_values", "surviving_values", "blocked_requests",
          "kept_out_values", "restored_values", "withheld_values", "ambiguous_links", "ambiguous_requests"]


def normalize_model(model: Column) -> Column:
    """Trimmed model name, ``unknown`` when empty, cut to a bounded length with an ellipsis."""
    m = F.trim(model)
    return F.when(m.isNull() | (m == ""), "unknown").when(
        F.length(m) > fixed.MAX_MODEL_LEN, F.concat(F.substring(m, 1, fixed.MAX_MODEL_LEN - 3), F.lit("…"))).otherwise(m)


def event_filter(events: DataFrame) -> DataFrame:
    """Events that say something: any count, or a block reason."""
    kept = (
        (F.col("redacted_values") > 0) | (F.col("surviving_values") > 0)
        | (F.coalesce("ambiguous_links", F.lit(0)) > 0) | F.col("block_reason").isNotNull()
    )
    return events.filter(kept).withColumn("model", normalize_model(F.col("model"))).withColumn(
        "ambiguous_links", F.greatest(F.coalesce("ambiguous_links", F.lit(0)), F.lit(0)))


def request_key() -> Column:
    """An event without request id counts as a request of its own."""
    return F.coalesce(F.concat(F.lit("request:"), F.col("request_id").cast("string")),
                      F.concat(F.lit("event:"), F.col("event_index").cast("string")))


def kept_out() -> Column:
    return F.col("redacted_values") + F.when(F.col("blocked"), F.col("surviving_values")).otherwise(0)


def stats_totals(events: DataFrame) -> DataFrame:
    """One row of totals."""
    key = request_key()
    return events.agg(
        F.count("*").alias("events"), F.count_distinct(key).alias("affected_requests"),
        F.coalesce(F.sum("redacted_values"), F.lit(0)).alias("redacted_values"),
        F.coalesce(F.sum("surviving_values"), F.lit(0)).alias("surviving_values"),
        F.count_distinct(F.when(F.col("blocked"), key)).alias("blocked_requests"),
        F.coalesce(F.sum(kept_out()), F.lit(0)).alias("kept_out_values"),
        F.coalesce(F.sum("ambiguous_links"), F.lit(0)).alias("ambiguous_links"),
        F.count_distinct(F.when(F.col("ambiguous_links") > 0, key)).alias("ambiguous_requests"),
    )


def stats_by(events: DataFrame, dimensions: Sequence[str] = ("model", "surface", "wire")) -> DataFrame:
    """Buckets of each dimension in one pass over the events."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"),
                 F.coalesce(F.when(F.col(d) != "", F.col(d)), F.lit("unknown")).alias("name")) for d in dimensions]))
    key = request_key()
    # distinct requests are pre-aggregated per (bucket, request), which spreads a hot bucket over all tasks
    per_request = events.withColumn("_b", pairs).withColumn("_k", key).groupBy("_b.dimension", "_b.name", "_k").agg(
        F.sum("redacted_values").alias("r"), F.sum("surviving_values").alias("s"), F.sum(kept_out()).alias("o"),
        F.max(F.col("blocked").cast("int")).alias("b"))
    return per_request.groupBy("dimension", "name").agg(
        F.count("*").alias("requests"), F.sum("r").alias("redacted_values"), F.sum("s").alias("surviving_values"),
        F.sum("b").alias("blocked_requests"), F.sum("o").alias("kept_out_values"))


def stats_by_label(events: DataFrame) -> DataFrame:
    """Value counts per label from the redacted and surviving hit arrays."""
    key = request_key()
    both = F.explode(F.concat(
        F.transform("redacted_hits", lambda h: F.struct(h.alias("h"), F.lit(1).alias("red"))),
        F.transform("surviving_hits", lambda h: F.struct(h.alias("h"), F.lit(0).alias("red")))))
    label = ["name", "source", "plugin", "kind", "confidence"]
    hits = events.select(key.alias("_k"), "blocked", both.alias("x")).select(
        "_k", "blocked", F.col("x.red").alias("red"),
        F.coalesce(F.when(F.col("x.h.name") != "", F.col("x.h.name")), F.lit("<unknown>")).alias("name"),
        F.coalesce(F.when(F.col("x.h.source") != "", F.col("x.h.source")), F.lit("unknown")).alias("source"),
        *[F.coalesce(F.col(f"x.h.{c}"), F.lit("")).alias(c) for c in label[2:]])
    stopped = F.col("blocked") & (F.col("red") == 0)
    per = hits.groupBy(*label, "_k").agg(
        F.sum("red").alias("r"), F.sum(1 - F.col("red")).alias("s"), F.max(stopped.cast("int")).alias("b"),
        F.sum(F.when(F.col("red") == 1, 1).when(stopped, 1).otherwise(0)).alias("o"))
    return per.groupBy(*label).agg(
        F.count("*").alias("requests"), F.sum("r").alias("redacted_values"), F.sum("s").alias("surviving_values"),
        F.sum("b").alias("blocked_requests"), F.sum("o").alias("kept_out_values"))


def top_buckets(buckets: DataFrame, n: int = 3, within: Sequence[str] = ("dimension",)) -> DataFrame:
    """The ``n`` strongest buckets of each dimension."""
    order = [F.col("kept_out_values").desc(), F.col("redacted_values").desc(), F.col("name")]
    return buckets.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(*order))).filter(F.col("rank") <= n)


def newest_events(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events, newest first (a top-k sort, not a full one)."""
    return events.orderBy(F.col("event_index").desc()).limit(n)


def event_limit(raw: str | None, default: int = 100) -> int:
    """Number of events that a query parameter asks for."""
    try:
        n = float(raw) if raw and raw.strip() else float("nan")
    except ValueError:
        n = float("nan")
    return default if not n >= 1 else int(n)


def safe_label(label: Column, protected: Column, surrogate_pattern: str, fallback: str) -> Column:
    """Label that never repeats a protected value or token (``protected``: it holds one)."""
    text = F.trim(label)
    bad = text.isNull() | (text == "") | protected | text.rlike(surrogate_pattern)
    return F.when(bad, fallback).otherwise(text)


# ------------------------------------------------------------------------ A5
def egress_proofs(surfaces: DataFrame, scope: str = "scope", event: str = "event_id") -> DataFrame:
    """One proof per request over its surfaces, with label counts."""
    keys = [scope, event]
    base = surfaces.groupBy(*keys).agg(
        F.sum("redacted_values").alias("redacted_values"), F.sum("surviving_values").alias("surviving_values"),
        F.sum("ambiguous_links").alias("ambiguous_links"),
        F.when(F.bool_or("detector_unavailable"), "detector_unavailable")
        .when(F.bool_or("protected"), "completed").otherwise("not_configured").alias("screening"),
        F.when(F.bool_or("upstream_error"), "upstream_error").when(F.bool_or("blocked"), "blocked")
        .otherwise("forwarded").alias("outcome"), F.max("model").alias("model"), F.max("at").alias("at"))
    both = F.explode(F.concat(
        F.transform("redacted_hits", lambda h: F.struct(h.alias("h"), F.lit(1).alias("red"))),
        F.transform("surviving_hits", lambda h: F.struct(h.alias("h"), F.lit(0).alias("red")))))
    labels = surfaces.select(*keys, both.alias("x")).groupBy(*keys, "x.h").agg(
        F.sum("x.red").alias("redacted_values"), F.sum(1 - F.col("x.red")).alias("surviving_values"))
    grouped = labels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "h.name", "h.source", "h.plugin", "h.kind", "h.confidence", "redacted_values", "surviving_values"))).alias("labels"))
    return base.join(grouped, keys, "left")


def thread_receipt(events: DataFrame, thread: str = "thread_id") -> DataFrame:
    """Counts of a thread's egress events and the root of its hash chain."""
    return events.groupBy(thread).agg(
        F.count("*").alias("events"), F.count_if(F.col("outcome") == "forwarded").alias("forwarded_requests"),
        F.count_if(F.col("outcome") == "blocked").alias("blocked_requests"),
        F.sum("redacted_values").alias("tokenized_values"), F.sum("surviving_values").alias("surviving_values"),
        F.sum("ambiguous_links").alias("ambiguous_links"),
        F.max_by("event_hash", F.struct("at", "event_id")).alias("chain_root"))


# ------------------------------------------------------------------------ A7
def daily_stats(snapshots: DataFrame, run: Sequence[str], counters: Sequence[str], today: Column | None = None,
                org: str = "org_id", at: str = "updated_at", order: Sequence[str] = ()) -> DataFrame:
    """Daily sums of clamped deltas between a run's cumulative snapshots, within retention."""
    by_run = W.partitionBy(org, *run).orderBy(at, *order)
    deltas = snapshots.select(org, F.to_date(at).alias("day"), *[
        F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(by_run), F.lit(0))).alias(c) for c in counters])
    daily = deltas.groupBy(org, "day").agg(*[F.sum(c).alias(c) for c in counters])
    some = sum((F.col(c) for c in counters), F.lit(0)) > 0
    kept = daily.filter(some)
    return kept if today is None else kept.filter(F.col("day") >= retention_cutoff(today))
