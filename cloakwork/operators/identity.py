"""Identity rules for business documents: people, organizations, dates and addresses in context.

Texts stay on their row for row-local rules.  Rules that walk words or lines explode them once
per document; rules that compare findings join on the document and the first word.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from cloakwork.functions import fixed
from cloakwork.functions.fixed import java
from cloakwork.functions.predicates import is_name_word, normalize_word
from cloakwork.functions.text import let, pin
from cloakwork.operators.detect import Detector
from cloakwork.operators.spans import MARK, cut, mark_safe, running, scan

WORD_PATTERN = f"({fixed.WORD})"


def words_of(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(WORD_PATTERN), F.lit(1))


def normalized_words(value: Column) -> Column:
    return F.transform(words_of(value), normalize_word)


def line_context(text: Column, start: Column) -> Column:
    """At most 160 characters before the span, on its line, behind the last ``.`` or ``;``."""
    head = F.substring(text, F.greatest(start - fixed.CONTEXT_CHARS, F.lit(0)) + 1,
                       F.least(start, F.lit(fixed.CONTEXT_CHARS)))
    return F.regexp_extract(head, r"([^\n.;]*)$", 1)


def _non_identity(words: Column) -> Column:
    return (
        F.exists(words, lambda w: w.isin(fixed.COURT_WORDS) | w.isin(fixed.ROLE_WORDS))
        | F.get(words, F.size(words) - 1).isin(fixed.LEGAL_CONCEPT_HEADS)
    )


def accepts_identity(text: Column, entity_type: Column, start: Column, value: Column) -> Column:
    """Admission of one NER candidate from its words and its context on the line."""
    def judged(b: Column) -> Column:
        n, raw, ctx = b.norm, b.raw, b.ctx
        vetoed = ctx.rlike(java(fixed.NON_IDENTITY_FIELD, True))
        names = F.forall(raw, is_name_word)
        person = (F.size(n) > 0) & ~_non_identity(n) & ~vetoed & F.when(
            ctx.rlike(java(fixed.PERSON_CUE, True)), F.size(n) <= 7
        ).otherwise((F.size(n) >= 2) & (F.size(n) <= 6) & names)
        at = F.array_position(n, "and").cast("int")
        core = lambda ws: F.filter(ws, lambda w: (w != "the") & ~w.isin(fixed.BUSINESS_DESIGNATORS))
        twice = F.when(at > 0, F.arrays_overlap(
            core(F.slice(n, 1, F.greatest(at - 1, F.lit(0)))),
            core(F.slice(n, F.greatest(at, F.lit(0)) + 1, F.size(n))))).otherwise(False)
        letters = F.regexp_replace(value, r"[^\p{L}]", "")
        upper = (F.length(letters) > 1) & (letters == F.upper(letters)) & (letters != F.lower(letters))
        organization = (F.size(n) > 0) & ~vetoed & (
            ((F.size(n) >= 2) & F.get(n, F.size(n) - 1).isin(fixed.BUSINESS_DESIGNATORS))
            | (~_non_identity(n) & ~twice & (
                F.exists(n, lambda w: w.isin(fixed.BUSINESS_DESIGNATORS))
                | F.when(ctx.rlike(java(fixed.ORGANIZATION_CUE, True)), F.size(n) <= 10).otherwise(
                    (F.size(n) >= 2) & (F.size(n) <= 8) & names & upper)
            ))
        )
        return F.coalesce(
            F.when(entity_type == "PERSON", person).when(entity_type == "ORGANIZATION", organization)
            .when(entity_type == "DATE_TIME", ctx.rlike(java(fixed.BIRTH_CUE, True)))
            .when(entity_type == "LOCATION", ctx.rlike(java(fixed.ADDRESS_CUE, True))),
            F.lit(False))

    return let(
        F.struct(normalized_words(value).alias("norm"), words_of(value).alias("raw"),
                 line_context(text, start).alias("ctx")),
        judged,
    )


def admit_identity(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NER spans ``(keys, text, entity_type, start, end)`` with ``accepted``.

    A one-word person is also admitted when its word occurs in an accepted longer person of the
    same document (a semi-join on the normalized word).
    """
    value = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    rated = spans.withColumn("value", value).withColumn(
        "accepted", accepts_identity(F.col("text"), F.col("entity_type"), F.col("start").cast("int"), F.col("value"))
    ).withColumn("words", normalized_words(F.col("value"))).drop("text")
    known = rated.filter("accepted and entity_type = 'PERSON' and size(words) > 1").select(
        *keys, F.explode("words").alias("_word"), F.lit(True).alias("_known")).distinct()
    one = F.when((F.col("entity_type") == "PERSON") & (F.size("words") == 1), F.get("words", F.lit(0)))
    return rated.withColumn("_word", one).join(known, [*keys, "_word"], "left").withColumn(
        "accepted", F.col("accepted") | F.coalesce("_known", F.lit(False))).drop("_word", "_known")


# -------------------------------------------------------------- D30 designators
_PLACES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_DESIGNATORS, _STOPS = frozenset(fixed.BUSINESS_DESIGNATORS), frozenset(fixed.ORG_PREFIX_STOPS)
_DESIGNATED = re.compile("|".join(fixed.BUSINESS_DESIGNATORS), re.IGNORECASE | re.ASCII)
_SEGMENT = re.compile(r"[^\t,;:!?()\[\]{}|\r\n]+")


@cache
def _word(plain: bool) -> re.Pattern:
    """``fixed.WORD``; behind ASCII a letter is a word character that is no number of any kind."""
    if plain:
        return re.compile(r"[A-Za-z][A-Za-z0-9_'.-]*")
    numbers = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
    return re.compile(rf"[^\W\d_{numbers}][\w'’.-]*")


def _name_word(word: str, norm: str) -> bool:
    """:func:`is_name_word` of one word."""
    letters = "".join(filter(str.isalpha, word))
    return norm in ("and", "of", "the") or (letters == letters.upper() != letters.lower()) or unicodedata.category(letters[0]) == "Lu"


def _named_before(text: str) -> list[tuple[int, int]]:
    """Spans of name words and the designator behind them: the walk goes back at most seven words of its segment."""
    found, pattern = [], _word(text.isascii())
    for segment in _SEGMENT.finditer(text):
        if not _DESIGNATED.search(segment.group()):
            continue
        words = [(w.start(), w.end(), w.group(), w.group().lower().rstrip(".'’")) for w in pattern.finditer(text, *segment.span())]
        for i, (_, end, _, norm) in enumerate(words):
            first = i
            if norm in _DESIGNATORS:
                while first > max(i - 7, 0) and words[first - 1][3] not in _STOPS and _name_word(*words[first - 1][2:]):
                    first -= 1
            if first < i:
                found.append((words[first][0], end))
    return found


@F.arrow_udf(_PLACES)
def _named_places(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _named_before(t) for t in texts.to_pylist()], to_arrow_type(_PLACES))


def designator_organizations(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Name words before a business designator, at most seven, up to the nearest stop word.

    Only texts that hold a designator at all are tokenized, by an Arrow pass: folds of array columns
    cost about a millisecond a text.
    """
    designators = "|".join(fixed.BUSINESS_DESIGNATORS)
    hinted = df.filter(F.col(text_col).rlike(rf"(?i)(?:{designators})"))
    spans = hinted.select(*keys, F.explode(_named_places(mark_safe(F.col(text_col)))).alias("s")).select(*keys, "s.start", "s.end")
    return spans.distinct().withColumn("rule", F.lit("organization")).withColumn("score", F.lit(0.9))


# ------------------------------------------------------------------ D31 aliases
def organization_aliases(organizations: DataFrame, docs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``The <stem>`` and ``<stem> <designator>`` mentions of a document's own organizations.

    Distinct stems per document are matched in one scan each; a document meets only its own stems.
    """
    stems = organizations.select(*keys, F.filter(
        words_of(F.col("value")),
        lambda w: ~normalize_word(w).isin([*fixed.BUSINESS_DESIGNATORS, "the"])).alias("w")).filter("size(w) > 0")
    quoted = F.transform("w", lambda w: F.regexp_replace(w, r"([.\-])", r"\\$1"))
    per_doc = stems.select(*keys, F.array_join(quoted, rf"[{fixed.WS}]+").alias("stem")).distinct().groupBy(*keys).agg(
        F.collect_list("stem").alias("stems"))
    suffixes = "|".join(sorted(fixed.BUSINESS_DESIGNATORS, key=len, reverse=True))
    gap = rf"[{fixed.WS}]+"
    edge = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
    return docs.select(*keys, text_col).join(per_doc, list(keys)).select(
        *keys, F.explode(F.flatten(F.transform("stems", lambda s: scan(
            mark_safe(F.col(text_col)),
            F.concat(F.lit(f"(?iu)({edge}(?:The{gap}"), s, F.lit("|"), s, F.lit(f"{gap}(?:{suffixes})){edge})")),
        )))).alias("s")
    ).select(*keys, "s.start", "s.end", "s.value").distinct()


def linked_single_words(raw: DataFrame, accepted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated one-word organizations that uniquely name a fuller one in the same document.

    Words and full names of a document meet in one shuffle.  In order of their starts the furthest end
    of the full names so far tells whether a word lies within one, so no pairs are made.
    """
    def worded(df: DataFrame) -> DataFrame:
        return df.filter("rule = 'organization'").select(*keys, "start", "end", pin(normalized_words(F.col("value"))).alias("w"))

    no_the = F.when(F.get("w", F.lit(0)) == "the", F.slice("w", 2, F.size("w"))).otherwise(F.col("w"))
    last = lambda w: F.array_max(F.transform(w, lambda x, i: F.when(~x.isin(fixed.ALIAS_LEGAL_DESIGNATORS), i + 1)))
    identity = pin(let(no_the, lambda w: F.slice(w, F.lit(1), F.coalesce(last(w), F.lit(0)))))
    full = worded(accepted).filter("size(w) > 1").select(*keys, "start", "end", identity.alias("identity")).select(
        *keys, "start", "end", F.get("identity", F.lit(0)).alias("alias"), "identity", F.lit(True).alias("full"))
    single = worded(raw).filter("size(w) = 1").select(
        *keys, "start", "end", F.get("w", F.lit(0)).alias("alias"), F.lit(None).cast("array<string>").alias("identity"),
        F.lit(False).alias("full"))
    rows = full.unionByName(single).dropna(subset=list(keys))
    # of equal starts full names come first
    in_text = W.partitionBy(*keys).orderBy("start", F.desc("full"), "end", "alias")
    reach = F.max(F.when(F.col("full"), F.col("end"))).over(in_text.rowsBetween(W.unboundedPreceding, W.currentRow))
    one = F.struct("start", "full", "end", "alias")
    placed = rows.withColumn("_reach", reach).withColumn("_before", F.lag(one).over(in_text))
    placed = placed.withColumn("_free", ~F.col("full") & ~one.eqNullSafe(F.col("_before")) & ~F.coalesce(
        F.col("end") <= F.col("_reach"), F.lit(False)))
    named = W.partitionBy(*keys, "alias")
    return placed.withColumn("_n", F.count_if("_free").over(named)).withColumn("_one", F.min("identity").over(named)).withColumn(
        "_other", F.max("identity").over(named)).filter("_free and _n >= 2 and _one = _other").select(*keys, "start", "end", "alias")


# ------------------------------------------------------------- D33, D34 by line
def lines_of(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keys, line_no, base, line) of each text; offsets are of the untouched text."""
    return df.select(*keys, F.explode(scan(mark_safe(F.col(text_col)), r"([^\r\n]+)")).alias("l")).select(
        *keys, F.col("l.start").alias("base"), F.col("l.value").alias("line"))


def letter_spaced_names(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Letter-spaced names (``J o h n``) on lines with a person or organization cue."""
    person = F.col("line").rlike(java(fixed.PERSON_CUE, True))
    org = F.col("line").rlike(java(fixed.ORGANIZATION_CUE, True))
    cued = lines_of(df, keys, text_col).withColumn("_org", org).filter(person | F.col("_org"))
    return cued.select(*keys, "base", "_org", F.explode(scan(F.col("line"), fixed.LETTER_SPACED)).alias("s")).filter(
        F.length(F.regexp_replace("s.value", r"[ \t]+", "")) >= 4
    ).select(
        *keys, (F.col("base") + F.col("s.start")).alias("start"), (F.col("base") + F.col("s.end")).alias("end"),
        F.col("s.value").alias("value"), F.when(F.col("_org"), "organization").otherwise("person").alias("rule"))


def tabular_organizations(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Organizations in the second field of dated rows below a transaction header.

    Only tabbed lines are kept and one running flag per document says whether a header came before.
    """
    lines = lines_of(df.filter(F.col(text_col).contains("\t")), keys, text_col).filter(F.col("line").contains("\t"))
    header = F.col("line").rlike(java(fixed.TRANSACTION_HEADER, True)) & F.col("line").rlike(java(fixed.AMOUNT_HEADER, True))
    marked = lines.withColumn("header", header)
    seen = F.max(F.col("header").cast("int")).over(
        W.partitionBy(*keys).orderBy("base").rowsBetween(W.unboundedPreceding, -1))
    fields = F.split("line", "\t")
    name = F.trim(F.get(fields, F.lit(1)))
    raw = words_of(F.col("value"))
    rows = marked.withColumn("seen", seen).filter("seen = 1 and not header").withColumn("value", name).withColumn(
        "lead", F.length(F.get(fields, F.lit(0))) + 1 + F.length(F.get(fields, F.lit(1)))
        - F.length(F.ltrim(F.get(fields, F.lit(1)))))
    ok = (
        F.trim(F.get(fields, F.lit(0))).rlike("(?i)" + fixed.DATE_FIELD)
        & (F.size(raw) >= 2) & (F.size(raw) <= 8)
        & normalize_word(F.get(raw, F.size(raw) - 1)).isin(fixed.BUSINESS_DESIGNATORS)
        & F.forall(raw, is_name_word)
    )
    return rows.filter(ok).select(
        *keys, (F.col("base") + F.col("lead")).alias("start"),
        (F.col("base") + F.col("lead") + F.length("value")).alias("end"), "value",
        F.lit("organization").alias("rule"), F.lit(0.65).alias("score"))


# ------------------------------------------------------------------ D37 markdown
def markdown_view(text: Column) -> Column:
    """struct<text, kept: array<struct<norm_start, raw_start, len>>>: text without Markdown syntax.

    ``kept`` is the piecewise map from the clean view back to the raw text.
    """
    marked = cut(mark_safe(text), fixed.MARKDOWN_REMOVE, f"$1{MARK}$2$3{MARK}")

    def build(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x))
        text_lengths = F.transform(p, lambda x, i: F.when(i % 2 == 0, F.length(x)).otherwise(0))
        kept = running(lengths, lambda a, w: a + w, lambda raw_at: running(
            text_lengths, lambda a, w: a + w, lambda norm_at: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(p) - 1, F.lit(2)), lambda i: F.length(F.get(p, i)) > 0),
                lambda i: F.struct(norm_at(i).alias("norm_start"), raw_at(i).alias("raw_start"),
                                   F.length(F.get(p, i)).alias("len")))))
        clean = F.array_join(F.filter(p, lambda x, i: i % 2 == 0), "")
        return F.struct(clean.alias("text"), kept.alias("kept"))

    return let(marked, build)


def to_raw(kept: Column, offset: Column, end: bool = False) -> Column:
    """Raw offset of a clean-view boundary; an end boundary stays with the text before it.

    The pieces are sorted, so the one at the offset is found by halving.
    """
    def piece(k: Column) -> Column:
        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
            at = F.get(k, middle)["norm_start"]
            left = (at < offset) if end else (at <= offset)
            return F.when(a["high"] - a["low"] <= 1, a).otherwise(F.struct(
                F.when(left, middle).otherwise(a["low"]).alias("low"), F.when(left, a["high"]).otherwise(middle).alias("high")))

        steps = F.sequence(F.lit(0), F.ceil(F.log2((F.size(k) + 1).cast("double"))).cast("int"))
        return let(F.get(k, F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(k).alias("high")), halve, lambda a: a["low"])), inside)

    def inside(p: Column) -> Column:
        fits = (p["norm_start"] < offset) & (offset <= p["norm_start"] + p["len"]) if end else (
            (p["norm_start"] <= offset) & (offset < p["norm_start"] + p["len"]))
        return F.when(fits, p["raw_start"] + offset - p["norm_start"])

    return let(kept, piece)


def on_markdown(detector: Detector) -> Detector:
    """A detector that reads texts without their Markdown syntax; its spans come back in raw offsets."""
    def run(df: DataFrame, ids: Sequence[str], text_col: str) -> DataFrame:
        view = df.select(*ids, pin(markdown_view(F.col(text_col))).alias("_v"))
        found = detector(view.select(*ids, F.col("_v.text").alias(text_col)), ids, text_col)
        raw = found.join(view.select(*ids, F.col("_v.kept").alias("_kept")), list(ids))
        start, behind = to_raw(F.col("_kept"), F.col("start")), to_raw(F.col("_kept"), F.col("end"), True)
        return raw.withColumn("start", start).withColumn("end", behind).drop("_kept", "value").filter("start is not null and end is not null")

    return run
