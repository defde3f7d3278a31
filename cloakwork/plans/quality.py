"""Detector quality and surrogate fidelity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.text import escape_regex, fold_ws
from cloakwork.operators.spans import span_overlap_join

KEEP_MARGIN = 0.02


# ----------------------------------------------------------------------- A11
def covered(expected: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected entities with ``detected``: a finding of the same type covers the whole span."""
    hit = span_overlap_join(
        expected.select(*keys, "entity", "start", "end").distinct(),
        findings.select(*keys, "entity", "start", "end").distinct(), [*keys, "entity"],
    ).filter("r_start <= start and r_end >= end").select(*keys, "entity", "start", "end").distinct()
    hit = hit.withColumn("detected", F.lit(True))
    return expected.join(hit, [*keys, "entity", "start", "end"], "left").fillna(False, ["detected"])


def rejected_controls(controls: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Negative controls ``(keys, value, start, end)`` per value, with ``rejected``: nothing touches any span."""
    touched = span_overlap_join(
        controls.select(*keys, "value", "start", "end"), findings.select(*keys, "start", "end").distinct(), list(keys),
    ).select(*keys, "value").distinct().withColumn("touched", F.lit(True))
    values = controls.select(*keys, "value").distinct()
    return values.join(touched, [*keys, "value"], "left").select(*keys, "value", F.col("touched").isNull().alias("rejected"))


def detector_quality(expected: DataFrame, controls: DataFrame, findings: DataFrame, keys: Sequence[str],
                     label: str = "detector") -> DataFrame:
    """Identity recall and negative-control rejection per detector ``label`` column value."""
    by = [label, *keys]
    recall = covered(expected, findings, by).groupBy(label).agg(
        F.count("*").alias("expected"), F.count_if("detected").alias("detected"))
    control = rejected_controls(controls, findings, by).groupBy(label).agg(
        F.count("*").alias("controls"), F.count_if("rejected").alias("rejected"))
    return recall.join(control, label, "full_outer").fillna(0).withColumn(
        "identity_recall", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("detected") / F.col("expected"))
    ).withColumn("control_rejection", F.when(F.col("controls") == 0, 1.0).otherwise(F.col("rejected") / F.col("controls")))


def keep_new(quality: DataFrame, old: str, new: str, label: str = "detector") -> DataFrame:
    """The new detector is kept only when it gains the margin on both scores."""
    rows = quality.filter(F.col(label).isin(old, new)).groupBy().agg(*[
        F.max(F.when(F.col(label) == side, F.col(score))).alias(f"{name}_{score}")
        for name, side in (("old", old), ("new", new)) for score in ("identity_recall", "control_rejection")])
    better = (F.col("new_identity_recall") >= F.col("old_identity_recall") + KEEP_MARGIN) & (
        F.col("new_control_rejection") >= F.col("old_control_rejection") + KEEP_MARGIN)
    return rows.withColumn("recommendation", F.when(better, new).otherwise(old))


# ----------------------------------------------------------------------- A12
def fact_matches(answer: Column, expected: Column) -> Column:
    """The expected fact stands on its own in the answer and is not negated."""
    norm = lambda c: F.lower(fold_ws(F.coalesce(c, F.lit(""))))
    pattern = F.concat(F.lit(fixed.FACT_BEFORE), escape_regex(norm(expected)), F.lit(fixed.FACT_AFTER))
    return (norm(answer) != "") & (norm(expected) != "") & F.regexp_like(norm(answer), pattern)


def surrogate_fidelity(responses: DataFrame, keys: Sequence[str], token_pattern: str) -> DataFrame:
    """Scores per response ``(expected_tokens, listed_tokens, response, restored, facts)``.

    ``facts`` is ``array<struct<answer, expected>>``; ``parties`` is
    ``array<struct<answer, expected, answer_entity, expected_entity>>``.
    """
    shaped = lambda c: F.regexp_extract_all(c, F.lit(f"({token_pattern})"), F.lit(1))
    exact = F.array_intersect("listed_tokens", "expected_tokens")
    rate = lambda arr, ok: F.when(F.size(arr) == 0, 1.0).otherwise(F.size(F.filter(arr, ok)) / F.size(arr))
    return responses.select(
        *keys,
        F.when(F.size("expected_tokens") == 0, 1.0).otherwise(F.size(exact) / F.size(F.array_distinct("expected_tokens")))
        .alias("token_recall"),
        F.size(F.array_except(shaped(F.col("response")), "expected_tokens")).alias("mutations"),
        F.size(shaped(F.col("restored"))).alias("residuals"),
        rate(F.col("parties"), lambda p: p.answer.eqNullSafe(p.expected)).alias("exact_parties"),
        rate(F.col("parties"), lambda p: F.coalesce(p.answer_entity == p.expected_entity, F.lit(False))).alias("attribution"),
        rate(F.col("facts"), lambda f: fact_matches(f.answer, f.expected)).alias("facts"),
    )


# ----------------------------------------------------------------------- A13
def fidelity_gate(scores: DataFrame, keys: Sequence[str], expected_results: int | None = None) -> DataFrame:
    """Runs that miss a perfect score, with reasons; a wrong result count is one more failure row."""
    reasons = F.array_compact(F.array(
        F.when(F.col("error").isNotNull(), F.concat(F.lit("provider error: "), "error")) if "error" in scores.columns
        else F.lit(None).cast("string"),
        *[F.when(~F.coalesce(F.col(c) == 1.0, F.lit(False)), f"{c} must equal 1")
          for c in ("exact_parties", "attribution", "facts", "token_recall")],
        *[F.when(~F.coalesce(F.col(c) == 0, F.lit(False)), f"{c} must equal 0") for c in ("mutations", "residuals")],
    ))
    failed = scores.select(*[F.col(k).cast("string").alias(k) for k in keys], reasons.alias("reasons")).filter(F.size("reasons") > 0)
    if expected_results is None:
        return failed
    count = scores.agg(F.count("*").alias("n")).filter(F.col("n") != expected_results).select(
        *[F.lit(None).cast("string").alias(k) for k in keys],
        F.array(F.concat(F.lit(f"expected {expected_results} result(s), received "), F.col("n").cast("string"))).alias("reasons"))
    return failed.unionByName(count)


# ----------------------------------------------------------------------- A14
def characterize_render(rendered: DataFrame, mappings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per rendered document: distinct tokens, surfaces gone, round trip, one tag per entity."""
    joined = mappings.join(rendered, list(keys))
    return joined.groupBy(*keys).agg(
        F.count_distinct("token").alias("distinct_tokens"),
        F.bool_and(~F.col("rendered").contains(F.col("surface"))).alias("surfaces_absent"),
        F.bool_and(F.col("restored") == F.col("source")).alias("exact_round_trip"),
        (F.count_distinct("entity_id") == F.count_distinct("entity_tag")).alias("one_tag_per_entity"),
        (F.count_distinct("surface") == F.count_distinct("surface_tag")).alias("one_tag_per_surface"),
    )
