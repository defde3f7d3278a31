"""Scope memory: what one conversation has seen stays protected in its later turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.bodies import literals
from cloakwork.operators.detect import Rule, detect
from cloakwork.operators.match import FORM_DEFAULTS, match_scoped, scoped_candidates
from cloakwork.plans.redact import Redactor
from cloakwork.session import checkpoint

LEDGER = ["value", "first_turn", "name", "source", "kind", "confidence", "entity_id", "entity_type", "protection_kind"]


def first_seen(found: DataFrame, scope: str, turn: str) -> DataFrame:
    """First turn of each (scope, value), with the attributes of its first finding."""
    return found.groupBy(scope, "value").agg(
        F.min_by(F.struct("rule", "kind", "confidence", "source"), F.struct(turn, "rule")).alias("m"),
        F.min(turn).alias("first_turn"),
    ).select(scope, "value", "first_turn", F.col("m.rule").alias("name"), "m.kind", "m.confidence", "m.source",
             F.lit("detected").alias("authority"))


def carry_forward(turns: DataFrame, scope: str, turn: str, text_col: str, rules: Sequence[Rule] = (),
                  known: DataFrame | None = None) -> DataFrame:
    """Occurrences of a scope's values in the turn that showed them first and all later ones.

    ``known`` gives the values (with ``first_turn``) instead of running the rules.  Texts meet only
    the values of their own scope whose anchor they contain; scopes never mix.
    """
    values = known if known is not None else first_seen(detect(turns, [scope, turn], text_col, rules), scope, turn)
    return match_scoped(
        turns, [scope, turn], text_col, values, [scope], [turn], F.col(turn) >= F.col("first_turn"))


# ------------------------------------------------------------------- the ledger of a scope
def seen_values(redactor: Redactor, bodies: DataFrame, scope: str, turn: str, body_col: str = "body",
                detections: str | None = None) -> DataFrame:
    """(scope, value, first_turn, …) of what the bodies show; the earliest turn names a value."""
    read = redactor.body_values(bodies, [scope, turn], body_col, detections)
    rows = read.select(scope, F.col(turn).alias("first_turn"), F.explode("_detected").alias("f"))
    attributes = F.struct(*[F.col(f"f.{c}").alias(c) for c in LEDGER if c not in ("value", "first_turn")])
    return rows.groupBy(scope, F.col("f.value").alias("value")).agg(
        F.min("first_turn").alias("first_turn"), F.min_by(attributes, F.struct("first_turn", attributes)).alias("m")
    ).select(scope, "value", "first_turn", "m.*")


def empty_ledger(bodies: DataFrame, scope: str, turn: str) -> DataFrame:
    """A ledger with no row yet, typed after the bodies."""
    texts = [F.lit(None).cast("string").alias(c) for c in LEDGER if c not in ("value", "first_turn")]
    return bodies.limit(0).select(scope, F.lit("").alias("value"), F.col(turn).alias("first_turn"), *texts, F.lit(0).cast("long").alias("version"))


def merge_ledger(ledger: DataFrame, seen: DataFrame, scope: str, version: int) -> DataFrame:
    """The ledger with what a run has seen: a new value is a new row, a known one keeps its row.

    Rows carry the version that wrote them last; a value known from an earlier turn than before moves
    to that turn.  The same run merged again changes nothing.
    """
    key = [scope, "value"]
    new = seen.select(*key, *[F.col(c).alias(f"_new_{c}") for c in LEDGER if c != "value"])
    both = ledger.join(new, key, "full_outer")
    earlier = F.col("first_turn").isNull() | F.coalesce(F.col("_new_first_turn") < F.col("first_turn"), F.lit(False))
    return both.select(
        *key, *[F.when(earlier, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in LEDGER if c != "value"],
        F.when(earlier, F.lit(version).cast("long")).otherwise(F.col("version")).alias("version"))


def with_scope_forms(bodies: DataFrame, keys: Sequence[str], body_col: str, forms: DataFrame, scope: str, out: str,
                     turn: str | None = None) -> DataFrame:
    """Add the array of forms of a body's own scope whose anchor its literals contain.

    With ``turn``, forms of later turns (column ``first_turn``) are left out.  A scope may hold any
    number of forms: bodies meet those they may contain, never all of their scope.
    """
    keys = list(keys)
    joined = F.array_join(F.transform(literals(F.col(body_col)), lambda x: x["text"]), "\n\n")
    own = [c for c in dict.fromkeys([*keys, scope, *([turn] if turn else [])])]
    rows = scoped_candidates(
        bodies.select(*own, joined.alias("_joined")), keys, "_joined", forms, [scope], [turn] if turn else [],
        F.col(turn) >= F.col("first_turn") if turn else None)
    per_body = rows.groupBy(*keys).agg(F.collect_set("form").alias(out))
    none = F.array().cast(forms_type())
    return bodies.join(per_body, keys, "left").withColumn(out, F.coalesce(out, none))


def forms_type() -> str:
    """Type of an array of forms."""
    fields = ["value", *FORM_DEFAULTS]
    return "array<struct<" + ",".join(f"{c}:string" for c in fields) + ">>"


def redact_turns(redactor: Redactor, bodies: DataFrame, scope: str, turn: str, body_col: str = "body",
                 ledger: DataFrame | None = None, user: DataFrame | None = None, version: int = 1,
                 context_col: str | None = None, detections: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Redact bodies with the memory of their scope; returns (redacted bodies, grown ledger).

    What a turn showed is replaced in that turn and in all later ones of its scope, in any letter case
    and across reflowed line breaks, also where no rule sees it; other scopes never notice.
    ``user`` has the values that users selected (scope, value): they win like registered ones.
    """
    start = ledger if ledger is not None else empty_ledger(bodies, scope, turn)
    grown = checkpoint(merge_ledger(start, seen_values(redactor, bodies, scope, turn, body_col, detections), scope, version))
    known = grown.select(scope, "first_turn", *[c for c in LEDGER if c != "first_turn"], F.lit("detected").alias("authority"))
    keys = [scope, turn]
    out = with_scope_forms(bodies, keys, body_col, known, scope, "_memory", turn)
    if user is not None:
        out = with_scope_forms(out, keys, body_col, user, scope, "_user").withColumn("_memory", F.concat("_user", "_memory")).drop("_user")
    return redactor.redact_bodies(out, keys, body_col, context_col, "_memory", detections).drop("_memory"), grown
