"""Streaming scope memory, swept-leaf ledger, live registry reload and running stats."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cloakwork.operators.detect import Rule, detect
from cloakwork.plans.redact import Redactor

IDLE_TTL_MS = 30 * 60 * 1000
SEEN = Row("scope", "value", "first_turn", "new")


class _ScopeMemory(StatefulProcessor):
    """Values seen so far per scope, each with an idle time to live."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "first_turn bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # each value meets the state once per micro-batch, not once per row
        first: dict[str, int | None] = {}
        fresh: dict[str, int] = {}
        for row in rows:
            value, turn = row.value, int(row.turn)
            known = value in fresh or value in first
            if not known:
                known = self.seen.containsKey((value,))
                first[value] = self.seen.getValue((value,))[0] if known else None
            fresh[value] = min(turn, *(x for x in (fresh.get(value), first[value]) if x is not None)) if known else turn
            yield SEEN(key[0], value, fresh[value], not known)
        for value, turn in fresh.items():
            # an idle time to live starts again, whatever the turn
            if self.ttl_ms or turn != first[value]:
                self.seen.updateValue((value,), (turn,))

    def close(self) -> None:
        return None


def scope_memory(found: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream of ``(scope, turn, value)`` to ``(scope, value, first_turn, new)``.

    With ``ttl_ms`` the query needs processing time and must be stopped by its owner.
    """
    return found.select("scope", "turn", "value").groupBy("scope").transformWithState(
        _ScopeMemory(ttl_ms), "scope string, value string, first_turn bigint, new boolean", "append",
        "ProcessingTime" if ttl_ms else "None")


def swept_once(leaves: DataFrame, scope: str = "scope", text_col: str = "text",
               watermark: tuple[str, str] | None = None) -> DataFrame:
    """Leaves whose text their scope has not shown before; a watermark bounds the state."""
    hashed = leaves.withColumn("leaf_hash", F.sha2(F.col(text_col), 256))
    if watermark is None:
        return hashed.dropDuplicates([scope, "leaf_hash"])
    return hashed.withWatermark(*watermark).dropDuplicatesWithinWatermark([scope, "leaf_hash"])


def detect_stream(texts: DataFrame, id_cols: Sequence[str], text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Rule findings of a stream; the scan is stateless."""
    return detect(texts, id_cols, text_col, rules)


class LiveRegistry:
    """Registered forms that only grow while a stream runs, kept as written versions.

    Each micro-batch writes the forms it sees for the first time under its epoch and works with all
    epochs up to its own.  The versions outlive the process: a restarted stream goes on with them, and
    an epoch that runs again overwrites its own version and sees the same forms as before.
    """

    def __init__(self, spark: SparkSession, place: str, schema: str = "value string") -> None:
        self.spark, self.folder, self.schema = spark, f"{place}/forms", schema
        # so that the folder can be read before the first epoch
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.folder}/epoch=-1")

    def upto(self, epoch: int) -> DataFrame:
        """Forms of all epochs up to this one."""
        typed = self.spark.read.schema(f"{self.schema}, epoch bigint").parquet(self.folder)
        return typed.filter(F.col("epoch") <= epoch).drop("epoch").distinct()

    def learn(self, forms: DataFrame, epoch: int) -> DataFrame:
        """Write what is new in ``forms``; returns the forms that are active in this epoch."""
        known = self.upto(epoch - 1)
        new = forms.select(*known.columns).distinct().join(known, known.columns, "left_anti")
        new.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")
        return self.upto(epoch)


def with_live_registry(registry: LiveRegistry, load_forms: Callable[[], DataFrame], make: Callable[[DataFrame], Redactor],
                       keys: Sequence[str], text_col: str, sink: Callable[[DataFrame, int], None]
                       ) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that re-reads the registry for each micro-batch.

    Reload is additive: a form once seen stays active, also when its source no longer lists it.
    ``sink`` gets the epoch, so that it can overwrite what an earlier attempt wrote.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        sink(make(registry.learn(load_forms(), epoch)).redact(batch, keys, text_col), epoch)

    return run


def running_stats(events: DataFrame) -> DataFrame:
    """Running value counts per wire and surface (update or complete mode).

    Distinct requests need the whole history; the batch totals give them.
    """
    return events.groupBy("wire", "surface").agg(
        F.count("*").alias("events"), F.sum("redacted_values").alias("redacted_values"),
        F.sum("surviving_values").alias("surviving_values"),
        F.sum(F.col("redacted_values") + F.when(F.col("blocked"), F.col("surviving_values")).otherwise(0))
        .alias("kept_out_values"))
