"""Detection rules and scans: secret shapes, structured personal data, document ids, phones.

A rule is data.  All rules run in one projection over the text, each guarded by cheap literal
anchors, and every rule is scanned on its own so that overlapping claims stay visible to the
resolver.  ``findings`` gives row-local arrays; :func:`detect` explodes them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions import predicates as P
from cloakwork.functions.fixed import java, re2
from cloakwork.functions.text import let, pin, trim_ws
from cloakwork.operators.spans import CONFIDENCE, MARK, cut, mark_safe, pieces_to_spans, rank_of, semi_overlap


@dataclass(frozen=True)
class Rule:
    """One scan: ``lead`` and ``tail`` are context around the protected ``value``."""

    name: str
    value: str
    lead: str = ""
    tail: str = ""
    ignore_case: bool = False
    anchors: tuple[str, ...] = ()      # one of these literals must occur (empty: always scan)
    guard: str = ""                    # or this cheaper pattern must match
    confidence: str = "high"
    kind: str = "secret"
    source: str = "secret-shape"
    score: float = 1.0
    country: str | None = None
    gate: Callable[[Column], Column] | None = None
    trim: bool = True                  # shared secret-shape clean-up (wrappers, placeholders)
    oracle_value: str = ""             # RE2 spelling where the Java one is refused
    trusted: bool = field(default=True, compare=False)

    @property
    def java(self) -> str:
        # the value pattern carries its own group 1 when it has no lead or tail
        if self.lead or self.tail:
            return java(f"({self.lead})({self.value})({self.tail})", self.ignore_case)
        return java(self.value, self.ignore_case)

    @property
    def replacement(self) -> str:
        return f"$1{MARK}$2{MARK}$3" if self.lead or self.tail else f"{MARK}$1{MARK}"

    @property
    def re2(self) -> str:
        value = self.oracle_value or self.value
        if self.lead or self.tail:
            return re2(f"({self.lead})({value})({self.tail})", self.ignore_case)
        return re2(value, self.ignore_case)


_WORD_GUARD = f"(?i)(?:{fixed.SECRET_WORD})"
SECRET_RULES: list[Rule] = [
    Rule(name, pattern, ignore_case=ci, anchors=tuple(anchors),
         gate={"private-key": lambda v: F.length(v) <= fixed.MAX_PRIVATE_KEY_LEN, "jwt": P.is_jwt}.get(name),
         oracle_value=f"({fixed.PRIVATE_KEY_RE2})" if name == "private-key" else "")
    for name, pattern, ci, anchors in fixed.KEY_SHAPES
] + [
    Rule("aws-secret-access-key", fixed.AWS_SECRET[1], fixed.AWS_SECRET[0], fixed.AWS_SECRET[2],
         ignore_case=True, guard="(?i)secret"),
    Rule("credential-url", fixed.CREDENTIAL_URL, ignore_case=True, anchors=("://",),
         gate=P.is_literal_credential_url),
    Rule("secret-assignment", fixed.ASSIGNMENT[1], *(fixed.ASSIGNMENT[0], fixed.ASSIGNMENT[2]),
         ignore_case=True, guard=_WORD_GUARD, confidence="probabilistic", gate=P.likely_secret),
    Rule("secret-json-value", fixed.JSON_LINES[1], fixed.JSON_LINES[0], fixed.JSON_LINES[2],
         ignore_case=True, guard=_WORD_GUARD, confidence="probabilistic", gate=P.likely_secret),
]

_PII = dict(kind="pii", source="pii-regex", trim=False)
PII_RULES: list[Rule] = [
    Rule("email", fixed.EMAIL, anchors=("@",), **_PII),
    Rule("us-ssn", fixed.US_SSN, anchors=("-",), **_PII),
    Rule("credit-card", fixed.CREDIT_CARD, gate=P.luhn_valid, guard="[0-9][ -]?[0-9][ -]?[0-9]", **_PII),
]

_DOC = dict(kind="pii", source="pii-analyzer", trim=False)
DOCUMENT_RULES: list[Rule] = [
    Rule("document-id", fixed.DOCUMENT_ID_LETTER8, score=0.65, confidence="probabilistic", **_DOC),
    Rule("document-id", fixed.DOCUMENT_ID_MIXED, score=0.85, **_DOC),
    # a look-behind keeps the plus sign from following a digit
    Rule("phone-number", r"(?<![0-9])" + fixed.MAURITIUS_PHONE, score=0.85, country="mu", anchors=("+230",),
         oracle_value=fixed.MAURITIUS_PHONE, **_DOC),
    Rule("account-number", r"(?<![0-9])" + fixed.ACCOUNT_NUMBER + r"(?![0-9])", score=0.3,
         confidence="probabilistic", oracle_value=fixed.ACCOUNT_NUMBER, **_DOC),
]
IDENTITY_FIELD_RULES: list[Rule] = [
    Rule("date-time", fixed.BIRTH_FIELD[1], fixed.BIRTH_FIELD[0], ignore_case=True, score=0.9,
         guard="(?i)birth|dob|d\\.o\\.b|born", **_DOC),
    Rule("company-registration", fixed.COMPANY_REG[1], fixed.COMPANY_REG[0], r"\b", ignore_case=True, score=0.9,
         guard="(?i)reg", gate=lambda v: v.rlike("[0-9]"), **_DOC),
    Rule("company-registration", fixed.COMPANY_REG_OCR[1], fixed.COMPANY_REG_OCR[0], ignore_case=True, score=0.9,
         guard="(?i)reg", **_DOC),
]
CONTEXT_WORDS = {
    "document-id": fixed.DOCUMENT_ID_CONTEXT,
    "phone-number": fixed.PHONE_CONTEXT,
    "account-number": fixed.ACCOUNT_CONTEXT,
}
# A context word near a match lifts its score by this much, to at least the floor (common analyzer defaults).
CONTEXT_BOOST, CONTEXT_FLOOR, CONTEXT_TOKENS = 0.35, 0.4, 5

FINDING = "array<struct<rule:string,start:int,end:int,value:string,kind:string,confidence:string,source:string,score:double>>"


def country_scope(rules: Sequence[Rule], countries: Sequence[str] | None) -> list[Rule]:
    """Rules without a country tag plus those of the listed countries; an unknown code is an error."""
    if countries is None:
        return list(rules)
    wanted = {c.strip().lower() for c in countries if c.strip()}
    unknown = sorted(wanted - {r.country for r in rules if r.country})
    if unknown:
        raise ValueError(f"no rule for countries: {', '.join(unknown)}")
    return [r for r in rules if r.country is None or r.country in wanted]


def _guarded(text: Column, rule: Rule) -> Column:
    pieces = cut(text, rule.java, rule.replacement)
    if rule.anchors:
        test = text.contains(rule.anchors[0])
        for literal in rule.anchors[1:]:
            test = test | text.contains(literal)
        return F.when(test, pieces)
    if rule.guard:
        return F.when(text.rlike(rule.guard), pieces)
    return pieces


def findings(text: Column, rules: Sequence[Rule], token_prefix: str = fixed.DEFAULT_PREFIX) -> Column:
    """``array<struct<rule,start,end,value,kind,confidence,source,score>>`` of all rule matches."""
    def scanned(safe: Column) -> Column:
        hits = F.filter(
            F.array(*[
                F.struct(
                    F.lit(i).alias("i"), F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"),
                    F.lit(r.confidence).alias("confidence"), F.lit(r.source).alias("source"),
                    F.lit(float(r.score)).alias("score"), F.lit(r.trim).alias("trim"),
                    _guarded(safe, r).alias("pieces"),
                )
                for i, r in enumerate(rules)
            ]),
            lambda h: F.size(h.pieces) > 1,
        )
        return F.flatten(F.transform(hits, lambda h: F.transform(
            pieces_to_spans(h.pieces),
            lambda s: F.struct(
                h.rule.alias("rule"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value"),
                h.kind.alias("kind"), h.confidence.alias("confidence"), h.source.alias("source"),
                h.score.alias("score"), h.i.alias("i"), h.trim.alias("trim"),
            ),
        )))

    def gated(f: Column) -> Column:
        ok = F.when(F.lit(False), F.lit(False))
        for i, r in enumerate(rules):
            if r.gate is not None:
                ok = ok.when(f.i == i, r.gate(f.value))
        return ok.otherwise(True)

    def cleaned(f: Column) -> Column:
        """Secret shapes lose wrappers and trailing punctuation; the span moves along."""
        def strip(v: Column) -> Column:
            head = F.regexp_replace(trim_ws(v), fixed.TRIM_HEAD, "")
            return let(
                F.struct(head.alias("head"), F.regexp_replace(head, fixed.TRIM_TAIL, "").alias("core")),
                lambda t: let(
                    f.start + F.length(v) - F.length(F.regexp_replace(
                        F.regexp_replace(v, rf"^[{fixed.WS}]+", ""), fixed.TRIM_HEAD, "")),
                    lambda s: F.struct(t.core.alias("value"), s.alias("start"), (s + F.length(t.core)).alias("end"))),
            )
        moved = F.when(f.trim, strip(f.value)).otherwise(
            F.struct(f.value.alias("value"), f.start.alias("start"), f.end.alias("end")))
        return let(moved, lambda m: F.struct(
            f.rule.alias("rule"), m.start.alias("start"), m.end.alias("end"), m.value.alias("value"),
            f.kind.alias("kind"), f.confidence.alias("confidence"), f.source.alias("source"),
            f.score.alias("score"), f.trim.alias("trim")))

    def admitted(f: Column) -> Column:
        return (f.value != "") & (~f.trim | (
            ~P.is_placeholder(f.value) & ~f.value.startswith(token_prefix) & ~f.value.contains("\u0000")))

    raw = let(mark_safe(text), scanned)
    kept = F.filter(F.transform(F.filter(raw, gated), cleaned), admitted)
    out = F.transform(kept, lambda f: F.struct(
        f.rule.alias("rule"), f.start.alias("start"), f.end.alias("end"), f.value.alias("value"),
        f.kind.alias("kind"), f.confidence.alias("confidence"), f.source.alias("source"), f.score.alias("score")))
    # the mark stand-in never shows: re-read the surface from the untouched text
    return F.when(text.contains(MARK), F.transform(out, lambda f: F.struct(
        f.rule.alias("rule"), f.start.alias("start"), f.end.alias("end"),
        F.substring(text, f.start + 1, f.end - f.start).alias("value"),
        f.kind.alias("kind"), f.confidence.alias("confidence"), f.source.alias("source"), f.score.alias("score"),
    ))).otherwise(out)


def detect(df: DataFrame, id_cols: Sequence[str], text_col: str, rules: Sequence[Rule],
           token_prefix: str = fixed.DEFAULT_PREFIX) -> DataFrame:
    """One row per match: ``(id_cols, rule, start, end, value, kind, confidence, source, score)``."""
    return df.select(
        *id_cols, pin(findings(F.col(text_col), rules, token_prefix)).alias("_fs")
    ).select(*id_cols, F.explode("_fs").alias("_f")).select(*id_cols, "_f.*")


# A detector is any callable from a text frame to findings; rule sets are the built-in ones.
Detector = Callable[[DataFrame, Sequence[str], str], DataFrame]


def rule_detector(rules: Sequence[Rule]) -> Detector:
    """Detector running a rule list."""
    return lambda df, ids, text_col: detect(df, ids, text_col, rules)


def run_detectors(leaves: DataFrame, id_cols: Sequence[str], text_col: str,
                  detectors: Sequence[tuple[str, Detector, str]]) -> DataFrame:
    """Union of detectors ``(name, callable, view)``; the ``content`` view hides object keys."""
    out = None
    for name, detector, view in detectors:
        seen = leaves.filter("kind <> 'key'") if view == "content" and "kind" in leaves.columns else leaves
        part = detector(seen, id_cols, text_col).withColumn("detector", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_values(found: Column) -> Column:
    """Distinct values of one text, keeping the first rule's attributes (rule order, then position)."""
    return let(F.transform(found, lambda f: f.value), lambda values: F.filter(
        found, lambda f, i: F.array_position(values, f.value) == i + 1))


def secret_header_findings(df: DataFrame, id_cols: Sequence[str], name_col: str, value_col: str) -> DataFrame:
    """Header values that pass the generic gate under a secret-ish header name."""
    value = P.trim_candidate(F.col(value_col))
    return (
        df.filter(F.col(name_col).rlike(_WORD_GUARD))
        .select(*id_cols, F.lit("secret-header").alias("rule"), value.alias("value"))
        .filter(P.likely_secret(F.col("value")) & ~P.is_placeholder(F.col("value")) & (F.col("value") != ""))
        .withColumn("confidence", F.lit("probabilistic"))
    )


def structural_pairs(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Secret-ish JSON keys joined to their own string value or direct array elements, by path.

    A value leaf names its owner: its own path, or its parent path when its last step is an
    array index.  Keys and values of one owner meet in one shuffle by path, whatever the document
    size; the leaves are read once and no side travels whole.
    """
    is_key, name = F.col("kind") == "key", F.col("text").rlike(_WORD_GUARD)
    owners = F.when(is_key, F.array("path")).otherwise(F.array_distinct(F.array(
        F.col("path"), F.regexp_replace("path", r"\[[0-9]+\]$", ""))))
    rows = leaves.filter((is_key & name) | (F.col("kind") == "value")).select(
        *keys, "kind", "path", "text", F.explode(owners).alias("owner"))
    named = F.max(is_key).over(Window.partitionBy(*keys, "owner"))
    values = rows.withColumn("named", named).filter("named and kind = 'value'")
    token = F.regexp_extract("text", fixed.LEADING_TOKEN, 1)
    return (
        values.withColumn("value", token)
        .filter(P.likely_secret(F.col("value")))
        .withColumn("value", P.trim_candidate(F.col("value")))
        .filter((F.col("value") != "") & ~P.is_placeholder(F.col("value")))
        .select(*keys, "path", F.lit("secret-json-value").alias("rule"), "value",
                F.lit("probabilistic").alias("confidence"))
        .distinct()
    )


def with_context_score(df: DataFrame, text_col: str, span: str = "") -> DataFrame:
    """Lift a finding's score when a context word of its rule occurs in the preceding tokens."""
    before = F.lower(F.regexp_extract(
        F.substring(F.col(text_col), F.lit(1), F.col(f"{span}start")),
        rf"((?:[^{fixed.WS}]+[{fixed.WS}]+){{0,{CONTEXT_TOKENS - 1}}}[^{fixed.WS}]*[{fixed.WS}]*)$", 1))
    near = F.when(F.lit(False), False)
    for rule, words in CONTEXT_WORDS.items():
        near = near.when(F.col("rule") == rule, before.rlike("(?:" + "|".join(words) + ")"))
    near = near.otherwise(False)
    boosted = F.least(F.lit(1.0), F.greatest(F.col("score") + CONTEXT_BOOST, F.lit(CONTEXT_FLOOR)))
    return df.withColumn("score", F.when(near, boosted).otherwise(F.col("score")))


# --------------------------------------------------------------- external spans (S9, F4)
def gate_spans(spans: DataFrame, threshold: float = fixed.SCORE_THRESHOLD,
               allow: Sequence[str] | None = None) -> DataFrame:
    """Admit analyzer spans ``(…, text, entity_type, start, end, score)`` and trim them.

    Malformed rows (nulls, empty or negative ranges) are dropped before the gates.
    """
    typed = spans.filter(
        F.col("entity_type").isNotNull() & F.col("score").isNotNull()
        & (F.col("start") >= 0) & (F.col("end") > F.col("start"))
        & (F.col("end") <= F.length("text")) & (F.col("score") >= threshold)
    )
    if allow:
        typed = typed.filter(F.upper("entity_type").isin([a.upper() for a in allow]))
    raw = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    typed = typed.withColumn("_raw", raw).withColumn("value", trim_ws(F.col("_raw")))
    lead = F.length("_raw") - F.length(F.regexp_replace("_raw", rf"^[{fixed.WS}]+", ""))
    named = F.upper("entity_type").isin(fixed.NAMED_ENTITY_TYPES)
    return (
        typed.filter(F.length("value") >= fixed.MIN_PII_LEN)
        .filter(~(named & (F.col("value").contains("\t") | ~F.col("value").rlike(r"\p{L}"))))
        .withColumn("start", F.col("start") + lead)
        .withColumn("end", F.col("start") + F.length("value"))
        .withColumn("rule", F.translate(F.lower("entity_type"), "_", "-"))
        .withColumn("confidence", F.when(F.col("score") >= fixed.HIGH_SCORE, "high").otherwise("probabilistic"))
        .withColumn("kind", F.lit("pii"))
        .drop("_raw", "text")
    )


# ------------------------------------------------------------------- D38 merge
def merge_findings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per value: preferred metadata, union of distinct spans.

    Preference: confidence, then medical source, then source name.  Contained values stay;
    the resolver arbitrates overlaps later.
    """
    medical = ((F.col("source") == "pii-medical") | F.col("rule").contains("medical") | F.col("rule").contains("health"))
    best = F.min_by(
        F.struct("rule", "kind", "confidence", "source"),
        F.struct(-rank_of(F.col("confidence"), CONFIDENCE), (~medical).cast("int"), F.col("source"), F.col("rule")),
    )
    return (
        df.filter(trim_ws(F.col("value")) != "")
        .groupBy(*keys, "value")
        .agg(
            best.alias("_b"),
            F.sort_array(F.collect_set(F.when(
                (F.col("start") >= 0) & (F.col("end") > F.col("start")), F.struct("start", "end")))).alias("spans"),
        )
        .select(*keys, "value", "_b.*", "spans")
    )


# ------------------------------------------------------------------- D39 chunks
def chunk_text(df: DataFrame, id_cols: Sequence[str], text_col: str, size: int = fixed.MAX_CHUNK_CHARS,
               overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of at most ``size`` characters with their base offset, packed newline first.

    Lines are packed greedily inside the row; a longer line is split hard with an overlap.
    """
    step = size - overlap

    def packed(text: Column) -> Column:
        lines = F.split(text, "\n", -1)
        zero = F.struct(
            F.lit(0).alias("pos"), F.lit(False).alias("open"), F.lit(0).alias("base"), F.lit(0).alias("end"),
            F.array().cast("array<struct<base:int,end:int>>").alias("out"))

        def flush(a: Column) -> Column:
            return F.when(a.open & (a.end > a.base), F.concat(a.out, F.array(F.struct(
                a.base.alias("base"), a.end.alias("end"))))).otherwise(a.out)

        def step_line(a: Column, line: Column) -> Column:
            n = F.length(line)
            nxt = (a.pos + n + 1).alias("pos")
            hard = F.transform(
                F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))),
                lambda k: F.struct((a.pos + k * step).alias("base"), F.least(a.pos + k * step + size, a.pos + n).alias("end")),
            )
            long_line = F.struct(nxt, F.lit(False).alias("open"), a.base.alias("base"), a.end.alias("end"),
                                 F.concat(flush(a), hard).alias("out"))
            has = a.open & (a.end > a.base)
            joins = has & (a.pos + n - a.base <= size)
            append = F.struct(nxt, F.lit(True).alias("open"), a.base.alias("base"), (a.pos + n).alias("end"), a.out.alias("out"))
            fresh = F.struct(nxt, F.lit(True).alias("open"), a.pos.alias("base"), (a.pos + n).alias("end"), flush(a).alias("out"))
            return F.when(n > size, long_line).when(joins, append).otherwise(fresh)

        return F.aggregate(lines, zero, step_line, flush)

    whole = F.array(F.struct(F.lit(0).alias("base"), F.length(F.col(text_col)).alias("end")))
    chunks = F.when(F.length(text_col) <= size, whole).otherwise(packed(F.col(text_col)))
    return df.select(*id_cols, F.col(text_col), pin(chunks).alias("_cs")).select(
        *id_cols, text_col, F.posexplode("_cs").alias("chunk", "_c")).select(
        *id_cols, "chunk", F.col("_c.base").alias("base"),
        F.substring(F.col(text_col), F.col("_c.base") + 1, F.col("_c.end") - F.col("_c.base")).alias("text"),
    )


# ----------------------------------------------------------------- D40, D41
def fresh_leaves(leaves: DataFrame, ledger: DataFrame, scope: str, text_col: str = "text") -> DataFrame:
    """Leaves whose text this scope has not swept yet."""
    hashed = leaves.withColumn("leaf_hash", F.sha2(F.col(text_col), 256))
    return hashed.join(ledger.select(scope, "leaf_hash").distinct(), [scope, "leaf_hash"], "left_anti")


def grow_ledger(ledger: DataFrame, swept: DataFrame, scope: str) -> DataFrame:
    """Ledger after a sweep; leaves count only where every detector completed."""
    done = swept.filter("complete").select(scope, "leaf_hash")
    return ledger.select(scope, "leaf_hash").unionByName(done).distinct()


def detect_distinct(df: DataFrame, id_cols: Sequence[str], text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Detect each distinct text once and join the findings back to every copy.

    Copies are grouped by text hash with a partial aggregate, so a text that a third of all
    rows share is scanned once and its rows meet a single small findings row.
    """
    hashed = df.select(*id_cols, F.col(text_col).alias("_t"), F.sha2(F.col(text_col), 256).alias("leaf_hash"))
    distinct = hashed.groupBy("leaf_hash").agg(F.min("_t").alias("_t"))
    found = distinct.select("leaf_hash", pin(findings(F.col("_t"), rules)).alias("f")).filter(F.size("f") > 0)
    return hashed.drop("_t").join(found, "leaf_hash").select(
        *id_cols, F.explode("f").alias("_f")).select(*id_cols, "_f.*")


def outage_route(requests: DataFrame, default_closed: bool = False) -> DataFrame:
    """Per request: is the sweep complete, and does an unavailable detector block it.

    ``requests`` has one row per (request, detector) with ``available`` and a nullable
    ``fail_closed`` override.
    """
    closed = F.coalesce(F.col("fail_closed"), F.lit(default_closed))
    return requests.groupBy("request_id").agg(
        F.bool_and("available").alias("complete"),
        F.bool_or(~F.col("available") & closed).alias("blocked"),
        F.count_if(~F.col("available")).alias("outages"),
    )


def drop_surrogates(df: DataFrame, tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occurrences that do not overlap an already minted token."""
    return semi_overlap(df, tokens, list(keys), anti=True)

