"""Registry operators: exclusion policy, union, versions, suggestions, review, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloakwork.functions import fixed
from cloakwork.functions.text import looks_high_entropy

USER_PLUGIN = "user-config"
_SHAPES = (fixed.REASON_URL, fixed.REASON_PATH, fixed.REASON_CONFIG)
REVIEW_STATES = ["protected", "user-excluded", "plugin-excluded", "stale-excluded"]


# ------------------------------------------------------------------- F2, F3, V5
def parse_exclusions(df: DataFrame, col: str) -> DataFrame:
    """Distinct names of comma lists with ``valid`` (exact environment-name shape)."""
    names = df.select(F.explode(F.split(col, ",")).alias("name")).select(F.trim("name").alias("name"))
    return names.filter("name <> ''").distinct().withColumn("valid", F.col("name").rlike(fixed.ENV_NAME))


def user_rules(names: DataFrame) -> DataFrame:
    """Enforced, trusted exclusion rows of the user's valid names (attributed first)."""
    return names.filter("valid").select(
        "name", F.lit("user-exclude-names").alias("rule_id"), F.lit(USER_PLUGIN).alias("plugin"),
        F.lit(True).alias("trusted"), F.lit(0).alias("rank"))


def apply_policy(values: DataFrame, rules: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split values into (kept, excluded).

    ``rules`` has one row per excluded name ``(name, rule_id, plugin, trusted, rank)``; untrusted
    rules never take effect.  The excluded side has one row per name, with the first source and the
    first rule (lowest rank, then plugin and id).
    """
    first_rule = rules.filter("trusted").groupBy("name").agg(
        F.min(F.struct("rank", "plugin", "rule_id")).alias("_r"))
    kept = values.join(first_rule.select("name"), "name", "left_anti")
    hit = values.join(first_rule, "name")
    once = hit.groupBy("name").agg(F.min_by(F.struct("source"), F.struct(*order)).alias("_s"), F.first("_r").alias("_r"))
    return kept, once.select("name", "_s.source", "_r.plugin", "_r.rule_id")


def excluded_by_source(excluded: DataFrame) -> DataFrame:
    """Excluded names counted once, per source."""
    return excluded.groupBy("source").agg(F.count("*").alias("excluded"))


# ------------------------------------------------------------------------ X1, K3
def union_registries(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources in order; for equal values the earliest source and name wins."""
    out = None
    for rank, df in enumerate(sources):
        part = df.withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    others = [c for c in out.columns if c != "value"]
    return out.groupBy("value").agg(
        F.min_by(F.struct(*others), F.struct("source_rank", "name")).alias("_w")).select("value", "_w.*")


def longest_value_first(df: DataFrame) -> DataFrame:
    """Registry order: longest value first, then name (a distributed range sort)."""
    return df.orderBy(F.length("value").desc(), "name", "value")


# ------------------------------------------------------------------------ J7
def registry_diff(active: DataFrame, loaded: DataFrame, key: str = "entity_id",
                  fields: Sequence[str] = ("value", "name", "source")) -> DataFrame:
    """Reload plan: additions register, changes and removals wait for a restart and stay active."""
    def printed(df: DataFrame, name: str) -> DataFrame:
        print_ = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])), 256)
        return df.select(key, print_.alias(name))
    both = printed(active, "was").join(printed(loaded, "now"), key, "full_outer")
    action = (
        F.when(F.col("was").isNull(), "register")
        .when(F.col("now").isNull(), "removed_needs_restart")
        .when(F.col("was") != F.col("now"), "changed_needs_restart").otherwise("unchanged")
    )
    return both.select(key, action.alias("action"), (action != "register").alias("active_before"),
                       F.lit(True).alias("active_after"))


# ------------------------------------------------------------------------ J8
def suggest_registry(proposed: DataFrame, registry: DataFrame) -> DataFrame:
    """Proposed values not registered in any letter case, one spelling each."""
    keyed = proposed.select(F.trim("value").alias("value")).filter("value <> ''").withColumn("k", F.lower("value"))
    once = keyed.groupBy("k").agg(F.min("value").alias("value"))
    known = registry.select(F.lower("value").alias("k")).distinct()
    return once.join(known, "k", "left_anti").select(
        "value", F.lit("other").alias("type"), F.lit("literal").alias("protection_kind"),
        F.lit("suggested").alias("source"), F.lit("suggested").alias("status"))


# ----------------------------------------------------------------------- D42, A9
def credential_shaped(value: Column) -> Column:
    userinfo = value.rlike("(?i)" + fixed.URL_USERINFO)
    return userinfo | value.rlike("(?i)" + fixed.CREDENTIAL_QUERY) | looks_high_entropy(value)


def benign_shape(value: Column) -> Column:
    """Fixed reason label of a non-secret value shape, or null."""
    url = value.rlike("(?i)" + fixed.URL_SCHEME + "[^/?#]") & ~value.rlike("(?i)" + fixed.URL_USERINFO)
    return (
        F.when(url, fixed.REASON_URL)
        .when(value.rlike(fixed.EXPLICIT_PATH), fixed.REASON_PATH)
        .when(value.rlike("(?i)" + fixed.CONFIG_VALUE)
              | ((F.length(value) <= 32) & value.rlike("(?i)" + fixed.WORD_SLUG)), fixed.REASON_CONFIG)
    )


def by_name(values: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per name: what its values look like, its sources, and the source and shape of its first value.

    Values are added up where they are read, per name and source and with numbers only as state, so a
    name that most values bear is a few rows before anything is dealt by name.
    """
    shape = benign_shape(F.col("value"))
    code = F.array_position(F.array(*map(F.lit, _SHAPES)), shape).cast("int")
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    each = values.groupBy("name", "source").agg(
        F.bool_or(credential_shaped(F.col("value"))).alias("_cred"), F.bool_and(shape.isNotNull()).alias("_benign"),
        F.min_by(code, at).alias("_code"), F.min(at).alias("_at"))
    return each.groupBy("name").agg(
        F.bool_or("_cred").alias("_cred"), F.bool_and("_benign").alias("_benign"), F.min_by("_code", "_at").alias("_code"),
        F.min_by("source", "_at").alias("_first"), F.array_sort(F.collect_set("source")).alias("sources")).withColumn(
        "_reason", F.get(F.array(*map(F.lit, _SHAPES)), F.col("_code") - 1))


def _with_verdict(grouped: DataFrame) -> DataFrame:
    listed = F.upper("name").isin(fixed.BENIGN_NAMES) | F.col("name").rlike("(?i)" + fixed.BENIGN_NAME_PATTERN)
    secret = F.col("name").rlike("(?i)" + fixed.CLASSIFY_SECRET_NAME) | F.col("name").rlike(
        "(?i)" + fixed.CLASSIFY_PII_NAME)
    reason = (
        F.when(F.col("_cred"), None).when(listed, fixed.REASON_NAME).when(secret, None)
        .when(F.col("_benign"), F.col("_reason"))
    )
    return grouped.withColumn("reason", reason).withColumn(
        "verdict", F.when(F.col("reason").isNull(), "keep-protected").otherwise("likely-non-secret"))


def classify_environment(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One verdict per name over all its values; the result never contains any part of a value."""
    shape = benign_shape(F.col("value"))
    grouped = df.groupBy("name").agg(
        F.bool_or(credential_shaped(F.col("value"))).alias("_cred"),
        F.bool_and(shape.isNotNull()).alias("_benign"),
        F.min_by(shape, F.struct(*order)).alias("_reason"),
    )
    return _with_verdict(grouped).select("name", "verdict", "reason")


def review_candidates(kept: DataFrame, excluded: DataFrame, user_names: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per name: sources, state, classification of protected names, default selection."""
    protected = kept.groupBy("name").agg(F.array_sort(F.collect_set("source")).alias("sources"),
                                         F.lit("protected").alias("state"))
    dropped = excluded.select(
        "name", F.array("source").alias("sources"),
        F.when(F.col("plugin") == USER_PLUGIN, "user-excluded").otherwise("plugin-excluded").alias("state"))
    found = protected.unionByName(dropped)
    stale = user_names.filter("valid").select("name").distinct().join(found, "name", "left_anti").select(
        "name", F.array().cast("array<string>").alias("sources"), F.lit("stale-excluded").alias("state"))
    rows = found.unionByName(stale)
    verdict = classify_environment(kept, order)
    out = rows.join(verdict, "name", "left").withColumn(
        "verdict", F.when(F.col("state") == "protected", F.col("verdict"))).withColumn(
        "reason", F.when(F.col("state") == "protected", F.col("reason")))
    return out.withColumn("selected", (F.col("state") == "protected")
                          & (F.coalesce("verdict", F.lit("")) != "likely-non-secret"))


def review_values(values: DataFrame, rules: DataFrame, user_names: DataFrame, order: Sequence[str]) -> DataFrame:
    """:func:`apply_policy` and :func:`review_candidates` in one: rules go by name, so names meet them, not values."""
    first_rule = rules.filter("trusted").groupBy("name").agg(F.min(F.struct("rank", "plugin", "rule_id")).alias("_r"))
    named = _with_verdict(by_name(values, order)).join(first_rule, "name", "left")
    kept = F.col("_r").isNull()
    found = named.select(
        "name", F.when(kept, F.col("sources")).otherwise(F.array("_first")).alias("sources"),
        F.when(kept, "protected").when(F.col("_r.plugin") == USER_PLUGIN, "user-excluded").otherwise("plugin-excluded").alias("state"),
        F.when(kept, F.col("verdict")).alias("verdict"), F.when(kept, F.col("reason")).alias("reason"))
    # no anti join, which would be moved below the distinct
    stale = user_names.filter("valid").select("name").distinct().join(
        found.select("name", F.lit(True).alias("_found")), "name", "left").filter("_found is null").select(
        "name", F.array().cast("array<string>").alias("sources"), F.lit("stale-excluded").alias("state"),
        F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(stale).withColumn("selected", (F.col("state") == "protected")
                                               & (F.coalesce("verdict", F.lit("")) != "likely-non-secret"))


def next_exclude_names(candidates: DataFrame, selected: DataFrame, current: DataFrame) -> DataFrame:
    """Current exclusions without the selected names, plus every unselected toggleable name."""
    # outer joins: a semi or anti join would be moved below the aggregations, to all values of a name
    picked = selected.select("name").distinct().withColumn("_picked", F.lit(True))
    toggle = candidates.filter("state <> 'plugin-excluded'").select("name").distinct().join(picked, "name", "left").withColumn(
        "_toggle", F.lit(True))
    rows = current.select("name").distinct().join(toggle, "name", "full_outer")
    return rows.filter("_toggle is null or _picked is null").select("name")


# ------------------------------------------------------------------- R20 upsert
def registry_upsert(current: DataFrame, incoming: DataFrame, user: str, now: Column) -> DataFrame:
    """Merge entries by id; approval stamps survive from the first approval, creators never change."""
    c = current.select([F.col(x).alias(f"c_{x}") for x in current.columns])
    joined = incoming.join(c, incoming["id"] == c["c_id"], "full_outer")
    new = F.col("id").isNotNull()
    status = F.coalesce("status", F.lit("approved"))
    approved = status == "approved"
    pick = {x: F.when(new, F.col(x)).otherwise(F.col(f"c_{x}")).alias(x) for x in ("value", "type", "source")}
    return joined.select(
        F.coalesce("id", "c_id").alias("id"), *pick.values(),
        F.when(new, status).otherwise(F.col("c_status")).alias("status"),
        F.coalesce("c_created_by", F.lit(user)).alias("created_by"),
        F.when(~new, F.col("c_approved_by")).when(approved, F.coalesce("c_approved_by", F.lit(user))).alias("approved_by"),
        F.when(~new, F.col("c_approved_at")).when(approved, F.coalesce(F.col("c_approved_at"), now)).alias("approved_at"),
        F.when(new, now).otherwise(F.col("c_updated_at")).alias("updated_at"),
    )


_STEP = r"(\.[A-Za-z_][A-Za-z0-9_-]*|\[[0-9]+\]|\['(?:[^'\\]|\\.)*+'\])"


def inspect_paths(leaves: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which registered names hit which JSON path; values never appear.

    A key that holds a registered value, or is no plain name, shows as ``<key#i>``, numbered within
    its body, so that different keys stay apart.
    """
    from cloakwork.operators.match import Dictionary

    keys = list(keys)
    d = Dictionary(registry)
    numbered = leaves.withColumn("leaf_path", F.when(F.col("kind") == "key", F.concat("path", F.lit(".$key"))).otherwise(F.col("path")))
    hits = d.occurrences(numbered, [*keys, "leaf_path"], "text")
    named = hits.groupBy(*keys, "leaf_path").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    last = F.regexp_extract("path", _STEP + "$", 1)
    bearing = d.occurrences(leaves.filter("kind = 'key'"), [*keys, "path"], "text").select(*keys, last.alias("step"))
    odd = leaves.filter("kind = 'key'").select(*keys, last.alias("step")).filter(F.col("step").startswith("['"))
    secret = bearing.union(odd).groupBy(*keys).agg(F.array_sort(F.collect_set("step")).alias("secret"))
    steps = F.regexp_extract_all("leaf_path", F.lit(_STEP), F.lit(1))
    hidden = F.coalesce("secret", F.array().cast("array<string>"))
    shown = F.transform(steps, lambda s: F.when(F.array_contains(hidden, s), F.concat(
        F.lit(".<key#"), F.array_position(hidden, s).cast("string"), F.lit(">"))).otherwise(s))
    path = F.concat(F.lit("$"), F.array_join(shown, ""), F.when(F.col("leaf_path").endswith(".$key"), ".$key").otherwise(""))
    return named.join(secret, keys, "left").select(*keys, path.alias("path"), "names")
