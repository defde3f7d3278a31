"""Text column helpers: binding, white space, JSON strings, offsets, entropy, query parts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cloakwork.functions import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A lambda body re-evaluates outer expressions for each element, so every shared
    intermediate is bound as a lambda variable over a one-element array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def pin(col: Column) -> Column:
    """Keep a costly column where it is computed.

    The optimizer copies deterministic column expressions into every filter it pushes below them
    (an ``explode`` alone adds one), and chained array columns multiply that.  A guard that is
    always true but not known to be so keeps each stage evaluated once per row.
    """
    return F.when(F.rand(0) + 1.0 > 0.5, col)


def prefix_fold(items: Column, zero: Column, step: Callable[[Column, Column], Column],
                emit: Callable[[Column, Column], Column], out_type: str) -> Column:
    """``emit(state, item)`` for every item, where ``state`` folds the items up to and with it.

    An array that grows along a fold is copied at each step, so the items are folded in blocks of
    about the square root of their number: the states between blocks first, then each block for itself.
    """
    def of(b: Column) -> Column:
        def block(k: Column) -> Column:
            return F.slice(b["items"], k * b["width"] + 1, b["width"])

        between = F.aggregate(
            F.filter(F.sequence(F.lit(0), F.greatest(b["blocks"] - 2, F.lit(0))), lambda k: k < b["blocks"] - 1),
            F.struct(zero.alias("state"), F.array(zero).alias("out")),
            lambda a, k: let(F.aggregate(block(k), a["state"], step), lambda s: F.struct(
                s.alias("state"), F.concat(a["out"], F.array(s)).alias("out"))),
            lambda a: a["out"])
        return F.flatten(F.transform(between, lambda start, k: F.aggregate(
            block(k), F.struct(start.alias("state"), F.array().cast(out_type).alias("out")),
            lambda a, x: let(step(a["state"], x), lambda s: F.struct(
                s.alias("state"), F.concat(a["out"], F.array(emit(s, x)).cast(out_type)).alias("out"))),
            lambda a: a["out"])))

    def sized(x: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int"))
        return let(width, lambda w: let(F.struct(
            x.alias("items"), w.alias("width"), F.ceil(F.size(x) / w).cast("int").alias("blocks")), of))

    return let(items, lambda x: F.when(F.size(x) > 0, sized(x)).otherwise(F.array().cast(out_type)))


def trim_ws(col: Column) -> Column:
    """Strip leading and trailing ECMAScript white space."""
    # a dollar sign would also match in front of a last U+0085, which is a line end but no such white space
    return F.regexp_replace(col, rf"^[{fixed.WS}]+|[{fixed.WS}]+\z", "")


def fold_ws(col: Column) -> Column:
    """Collapse white-space runs to one space and strip."""
    return trim_ws(F.regexp_replace(col, rf"[{fixed.WS}]+", " "))


@F.arrow_udf(StringType())
def _nfc(values: pa.Array) -> pa.Array:
    # one text at a time is held beside the batch
    return pa.array((None if v is None else unicodedata.normalize("NFC", v) for v in (x.as_py() for x in values)), pa.string())


def nfc(col: Column) -> Column:
    """NFC form.  Spark has no built-in, so an Arrow function runs, on rows that may change only.

    Characters below U+0300 neither combine nor decompose into a shorter form, so texts of them alone are in
    NFC.  A condition around the call would not spare such rows, an argument of null does.
    """
    changes = col.rlike(r"[^\x{0}-\x{2FF}]")
    return F.coalesce(_nfc(F.when(changes, col)), col)


def normalize_form(col: Column) -> Column:
    """NFC, folded white space, lower case: the identity of a registry surface."""
    return F.lower(fold_ws(nfc(col)))


def key_fold(col: Column) -> Column:
    """Lower case without the context-dependent final sigma (for look-up keys)."""
    lowered = F.lower(col)
    return F.when(lowered.contains("ς"), F.translate(lowered, "ς", "σ")).otherwise(lowered)


def escape_regex(col: Column) -> Column:
    """Quote regex syntax characters."""
    return F.regexp_replace(col, r"([\\.*+?^${}()|\[\]&#-])", r"\\$1")


def flexible_pattern(col: Column) -> Column:
    """Pattern source whose white space also matches one reflowed line break."""
    gap = fixed.FLEX_GAP.replace("\\", "\\\\")
    return F.regexp_replace(escape_regex(col), rf"[{fixed.WS}]+", gap)


def json_escape(col: Column) -> Column:
    """Content of the JSON string literal for a value, without its quotes."""
    literal = F.to_json(F.array(col))
    return F.substring(literal, F.lit(3), F.length(literal) - 4)


def json_unescape(literal: Column) -> Column:
    """Decode one quoted JSON string literal."""
    return F.element_at(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), 1)


JSON_LITERAL = r'"(?:[^"\\]|\\.)*+"'


def mask_json_strings(col: Column) -> Column:
    """Blank every string literal so that only primitives and structure remain."""
    return F.regexp_replace(col, JSON_LITERAL, '""')


def utf16_offset(text: Column, offset: Column) -> Column:
    """UTF-16 offset of a code-point offset."""
    head = F.substring(text, F.lit(1), offset)
    return offset + F.length(F.regexp_replace(head, r"[^\x{10000}-\x{10FFFF}]", ""))


def codepoint_offset(text: Column, offset: Column) -> Column:
    """Code-point offset of a UTF-16 offset (an offset inside a pair is null)."""
    # without characters outside the basic plane both offsets are the same
    def walk(b: Column) -> Column:
        return F.aggregate(
            F.split(b.text, ""),
            F.struct(F.lit(0).alias("unit"), F.lit(0).alias("point")),
            lambda a, c: F.when(
                a.unit < b.at,
                F.struct((a.unit + F.when(F.octet_length(c) == 4, 2).otherwise(1)).alias("unit"),
                         (a.point + 1).alias("point")),
            ).otherwise(a),
            lambda a: F.when(a.unit == b.at, a.point),
        )

    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), let(
        F.struct(text.alias("text"), offset.cast("int").alias("at")), walk)).otherwise(offset.cast("int"))


def longest_alnum_run(col: Column) -> Column:
    """First of the longest alphanumeric runs."""
    runs = F.split(col, "[^A-Za-z0-9]+")
    return F.aggregate(
        runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best)
    )


def shannon_entropy(col: Column) -> Column:
    """Bits per character."""
    return let(
        F.struct(F.length(col).cast("double").alias("n"), F.filter(F.split(col, ""), lambda c: c != "").alias("chars")),
        lambda s: F.when(s.n == 0, F.lit(0.0)).otherwise(
            F.aggregate(
                F.sort_array(F.array_distinct(s.chars)),
                F.lit(0.0),
                lambda acc, ch: let(
                    F.size(F.filter(s.chars, lambda x: x == ch)) / s.n,
                    lambda p: acc - p * F.log2(p),
                ),
            )
        ),
    )


def looks_high_entropy(col: Column) -> Column:
    """Known token prefix, long hex run, or a long run of high character entropy."""
    return let(
        F.struct(col.alias("v"), longest_alnum_run(col).alias("run")),
        lambda s: F.when(s.v.rlike(fixed.TOKEN_PREFIX), True)
        .when(s.run.rlike("^[0-9a-fA-F]{24,}$"), True)
        .when(F.length(s.run) >= 32, shannon_entropy(s.run) >= 3.0)
        .when(F.length(s.run) >= 16, shannon_entropy(s.run) >= 3.5)
        .otherwise(False),
    )


def decode_query(col: Column) -> Column:
    """Decode one query component; malformed input is returned as it is."""
    plain = F.regexp_replace(col, r"\+", " ")
    return F.coalesce(F.try_url_decode(plain), col)


def encode_query(col: Column) -> Column:
    """Percent-encode one component (space as ``%20``, the URI-unreserved marks kept)."""
    out = F.url_encode(col)
    for done, mark in [(r"\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = F.regexp_replace(out, done, mark)
    return out


def category_label(col: Column) -> Column:
    """Safe lower-case category label."""
    return F.translate(F.lower(col), "_", "-")


def utc_day(col: Column) -> Column:
    """UTC calendar day."""
    return F.to_date(col)


def retention_cutoff(day: Column, days: int = fixed.STATS_RETENTION_DAYS) -> Column:
    """First day still kept when ``days`` days are retained."""
    return F.date_sub(day, max(1, days) - 1)
