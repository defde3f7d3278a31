"""Restoring surrogates in responses: text, JSON, tool arguments, markers, residual checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from cloakwork.functions.surrogates import Surrogates
from cloakwork.functions.text import JSON_LITERAL, json_escape, json_unescape, let, pin
from cloakwork.operators.spans import mark_safe, overlaps, scan, splice

MARK_START, MARK_META, MARK_ORIGIN, MARK_END = "\u001eS\u001e", "\u001eM\u001e", "\u001eO\u001e", "\u001eE\u001e"
POLICIES = ("all", "none", "detected")


def restore_policy(value: str | None) -> str:
    """Restore-into-tools policy from its setting (boolean spellings are accepted)."""
    v = (value or "").strip().lower()
    if v in ("all", "1", "true", "yes", "on"):
        return "all"
    if v in ("none", "strict", "0", "false", "no", "off"):
        return "none"
    return "detected"


# ----------------------------------------------------------------------- J6
def resolve_layers(dictionary: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One value per (scope, token): the layer of lowest rank wins, with its provenance."""
    return dictionary.groupBy(*scope, "token").agg(
        F.min_by(F.struct("value", "layer"), F.struct("layer_rank", "value")).alias("b")
    ).select(*scope, "token", "b.value", "b.layer")


def attach_values(df: DataFrame, keys: Sequence[str], text_col: str, dictionary: DataFrame, scope: Sequence[str],
                  surrogates: Surrogates, out: str = "mapping") -> DataFrame:
    """Add ``map<token, struct<value, layer>>`` of the tokens that occur in each text.

    Only distinct (text, token) pairs meet the dictionary; texts without any token skip the join.
    """
    keys, scope = list(keys), list(scope)
    has = F.col(text_col).contains(surrogates.prefix)
    pattern = F.lit(f"({surrogates.pattern})")
    own = list(dict.fromkeys([*keys, *scope]))
    tokens = df.filter(has).select(*own, pin(F.array_distinct(F.regexp_extract_all(
        F.col(text_col), pattern, F.lit(1)))).alias("_ts")).select(*own, F.explode("_ts").alias("token"))
    found = tokens.join(resolve_layers(dictionary, scope), [*scope, "token"])
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("token"), F.struct("value", "layer")))).alias(out))
    empty = F.lit(None).cast("map<string,struct<value:string,layer:string>>")
    return df.filter(has).join(maps, keys, "left").unionByName(df.filter(~has | has.isNull()).withColumn(out, empty))


def _spans(text: Column, pattern: str, prefix: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.contains(prefix), scan(mark_safe(text), f"({pattern})")).otherwise(none)


def restore_column(text: Column, mapping: Column, surrogates: Surrogates, escape: bool = False,
                   skip: Column | None = None, nested: Column | None = None, markers: bool = False) -> Column:
    """Text with mapped tokens replaced; unknown ones stay.

    ``skip`` is an array of tokens to leave alone, ``nested`` an array of spans that are JSON inside
    a JSON string (escaped twice), ``markers`` wraps each value with its token and origin.
    """
    def value_of(s: Column) -> Column:
        hit = F.try_element_at(mapping, s.value)
        shown = F.concat(
            F.lit(MARK_START), s.value, F.lit(MARK_ORIGIN), hit.layer, F.lit(MARK_META), hit.value, F.lit(MARK_END)
        ) if markers else hit.value
        if not escape:
            return shown
        once = json_escape(shown)
        if nested is None:
            return once
        return F.when(F.exists(nested, lambda n: overlaps(n.start, n.end, s.start, s.end)), json_escape(once)).otherwise(once)

    def usable(s: Column) -> Column:
        ok = F.try_element_at(mapping, s.value).isNotNull()
        return ok & ~F.array_contains(skip, s.value) if skip is not None else ok

    spans = F.filter(_spans(text, surrogates.pattern, surrogates.prefix), usable)
    if markers:
        # a token inside an already complete marker stays as it is
        done = scan(mark_safe(text), f"((?s){MARK_START}.*?{MARK_END})")
        spans = let(F.when(text.contains(MARK_START), done).otherwise(
            F.array().cast("array<struct<start:int,end:int,value:string>>")), lambda m: F.filter(
            F.filter(_spans(text, surrogates.pattern, surrogates.prefix), usable),
            lambda s: ~F.exists(m, lambda d: overlaps(d.start, d.end, s.start, s.end))))
    return F.when(mapping.isNull(), text).otherwise(let(spans, lambda sp: splice(text, sp, value_of)))


def restore_text(df: DataFrame, keys: Sequence[str], text_col: str, dictionary: DataFrame, scope: Sequence[str],
                 surrogates: Surrogates, markers: bool = False) -> DataFrame:
    """Add ``restored``; exact tokens only, unknown ones stay."""
    out = attach_values(df, keys, text_col, dictionary, scope, surrogates)
    return out.withColumn("restored", pin(restore_column(F.col(text_col), F.col("mapping"), surrogates, markers=markers)))


# ----------------------------------------------------------------------- R9
def tool_regions(body: Column, wire: Column) -> Column:
    """Tool-argument texts of complete bodies, per provider wire."""
    v = F.try_parse_json(body)

    def texts(path: str, ddl: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, ddl), F.array().cast(ddl))

    block = "struct<type:string,input:variant>"
    call = "struct<type:string,arguments:string>"
    anthropic = F.concat(
        texts("$.content", f"array<{block}>"), texts("$.message.content", f"array<{block}>"),
        F.array_compact(F.array(F.try_variant_get(v, "$.content_block", block))))
    chat = texts("$.choices", "array<struct<message:struct<tool_calls:array<struct<function:struct<arguments:string>>>>>>")
    responses = F.concat(
        texts("$.output", f"array<{call}>"), texts("$.response.output", f"array<{call}>"),
        F.array_compact(F.array(F.try_variant_get(v, "$.item", call))))
    return (
        F.when(wire == "anthropic", F.array_compact(F.transform(
            F.filter(anthropic, lambda b: (b.type == "tool_use") & b.input.isNotNull()), lambda b: F.to_json(b.input))))
        .when(wire == "openai-chat", F.array_compact(F.flatten(F.transform(chat, lambda c: F.transform(
            F.coalesce(c.message.tool_calls, F.array().cast("array<struct<function:struct<arguments:string>>>")),
            lambda t: t.function.arguments)))))
        .when(wire == "openai-responses", F.array_compact(F.transform(
            F.filter(responses, lambda b: b.type == "function_call"), lambda b: b.arguments)))
        .otherwise(F.array().cast("array<string>"))
    )


def restore_json(df: DataFrame, keys: Sequence[str], body_col: str, wire_col: str, dictionary: DataFrame,
                 scope: Sequence[str], surrogates: Surrogates, policy: str = "detected",
                 markers: bool = False) -> DataFrame:
    """Restore JSON bodies in place, escaping values for the depth they sit at.

    Numbers and all other bytes stay.  Tokens in tool arguments follow ``policy``: ``all`` restores
    them, ``none`` keeps them, ``detected`` restores only values the requester had shown.  Adds
    ``restored``, ``withheld`` and ``into_tools`` (distinct values).
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    body = F.col(body_col)
    out = attach_values(df, keys, body_col, dictionary, scope, surrogates)
    out = out.withColumn("_regions", pin(F.when(F.col("mapping").isNotNull(), F.filter(
        tool_regions(body, F.col(wire_col)), lambda r: r.contains(surrogates.prefix)))))
    token = F.lit(f"({surrogates.pattern})")
    in_tools = F.array_distinct(F.flatten(F.transform("_regions", lambda r: F.regexp_extract_all(r, token, F.lit(1)))))
    keep = (lambda t: F.lit(False)) if policy == "all" else (
        (lambda t: F.lit(True)) if policy == "none" else
        (lambda t: F.try_element_at(F.col("mapping"), t).layer != "detected"))
    skip = F.filter(in_tools, lambda t: F.try_element_at(F.col("mapping"), t).isNotNull() & keep(t))
    out = out.withColumn("_skip", pin(F.coalesce(skip, F.array().cast("array<string>"))))
    # literals whose decoded content is a tool-argument text are JSON inside JSON
    nested = F.transform(
        F.filter(scan(mark_safe(body), f"({JSON_LITERAL})"), lambda lit: lit.value.contains(surrogates.prefix)
                 & F.array_contains(F.col("_regions"), json_unescape(lit.value))),
        lambda lit: F.struct(lit.start.alias("start"), lit.end.alias("end")))
    valid = F.try_parse_json(body).isNotNull()
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = out.withColumn("_nested", pin(F.when((F.size("_regions") > 0) & valid, nested).otherwise(none)))
    restored = F.when(
        valid, restore_column(body, F.col("mapping"), surrogates, True, F.col("_skip"), F.col("_nested"), markers)
    ).otherwise(restore_column(body, F.col("mapping"), surrogates, markers=markers))
    out = out.withColumn("restored", pin(restored))
    value_of = lambda t: F.try_element_at(F.col("mapping"), t).value
    out = out.withColumn("withheld", F.array_distinct(F.transform("_skip", value_of)))
    into = F.filter(in_tools, lambda t: F.try_element_at(F.col("mapping"), t).isNotNull()
                    & ~F.array_contains("_skip", t))
    out = out.withColumn("into_tools", F.coalesce(F.array_distinct(F.transform(into, value_of)), F.array().cast("array<string>")))
    return out.drop("_regions", "_skip", "_nested")


# ---------------------------------------------------------------- R11, A17, A16
def residual_tokens(text: Column, surrogates: Surrogates) -> Column:
    """Distinct token-shaped runs, whole or cut, in restored text."""
    none = F.array().cast("array<string>")
    return F.when(text.contains(surrogates.prefix), F.array_distinct(F.regexp_extract_all(
        text, F.lit(f"({surrogates.residual_pattern})"), F.lit(1)))).otherwise(none)


def residual_scan(df: DataFrame, keys: Sequence[str], text_col: str, dictionary: DataFrame, scope: Sequence[str],
                  surrogates: Surrogates) -> DataFrame:
    """Token-shaped runs without any mapping: mutated, truncated or invented ones."""
    shaped = df.select(*dict.fromkeys([*keys, *scope]), F.explode(
        residual_tokens(F.col(text_col), surrogates)).alias("token"))
    return shaped.join(dictionary.select(*scope, "token").distinct(), [*scope, "token"], "left_anti")


def restore_totals(restores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per response distinct values by outcome ``(restored, withheld, into_tools, residual)``, then summed."""
    per = restores.groupBy(*keys).agg(*[
        F.count_distinct(F.when(F.col("outcome") == o, F.col("value"))).alias(o)
        for o in ("restored", "withheld", "into_tools", "residual")])
    return per.agg(*[F.sum(o).alias(o) for o in ("restored", "withheld", "into_tools", "residual")])


def validate_restored(df: DataFrame, keys: Sequence[str], text_col: str, surrogates: Surrogates) -> DataFrame:
    """Counts of complete and truncated tokens left in text the reader sees."""
    p = surrogates.prefix
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"({p}[0-9A-Za-z_]+)"), F.lit(1))
    whole = (
        f"^(?:{surrogates.opaque_pattern}|{surrogates.typed_pattern}|{surrogates.entity_pattern})$")
    rows = df.select(*keys, F.when(F.col(text_col).contains(p), runs).otherwise(
        F.array().cast("array<string>")).alias("_runs"))
    return rows.select(
        *keys, F.size(F.filter("_runs", lambda r: r.rlike(whole))).alias("complete"),
        F.size(F.filter("_runs", lambda r: ~r.rlike(whole))).alias("truncated"),
    ).withColumn("total", F.col("complete") + F.col("truncated"))


# ----------------------------------------------------------------------- R12
def parse_markers(text: Column) -> Column:
    """struct<visible, restorations: array<struct<value, surrogate, origin>>> of marked text."""
    pattern = f"((?s){MARK_START}.*?{MARK_END})"
    inner = (rf"(?s)^{MARK_START}(?:(.*?){MARK_ORIGIN}(.*?){MARK_META})?(.*){MARK_END}$")

    def build(spans: Column) -> Column:
        parsed = F.transform(spans, lambda s: F.struct(
            F.regexp_extract(s.value, inner, 3).alias("value"), F.regexp_extract(s.value, inner, 1).alias("surrogate"),
            F.regexp_extract(s.value, inner, 2).alias("origin")))
        first = F.aggregate(parsed, F.filter(parsed, lambda r: F.lit(False)), lambda acc, r: F.when(
            (r.value == "") | (r.surrogate == "") | (r.origin == "") | F.exists(acc, lambda x: x.value == r.value), acc
        ).otherwise(F.concat(acc, F.array(r))))
        body = splice(text, spans, lambda s: F.regexp_extract(s.value, inner, 3))
        visible = F.regexp_replace(body, f"(?s){MARK_END}|{MARK_START}.*$", "")
        return F.struct(visible.alias("visible"), first.alias("restorations"))

    return let(scan(mark_safe(text), pattern), build)


