"""Boolean gates over candidate values (all built-in expressions, usable inside lambdas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.fixed import java
from cloakwork.functions.text import let, trim_ws


def trim_candidate(col: Column) -> Column:
    """Strip wrappers in front and closing punctuation behind."""
    return F.regexp_replace(F.regexp_replace(trim_ws(col), fixed.TRIM_HEAD, ""), fixed.TRIM_TAIL, "")


def is_placeholder(col: Column) -> Column:
    return col.rlike("(?i)" + fixed.PLACEHOLDER)


def credential_url_password(col: Column) -> Column:
    """Password of a value that is a whole credential URL, else the empty string."""
    return F.regexp_extract(col, "(?i)" + fixed.WHOLE_CREDENTIAL_URL, 1)


def is_credential_template(col: Column) -> Column:
    """The password is one whole variable expression, so no credential is in the text."""
    return col.rlike(fixed.CREDENTIAL_TEMPLATE)


def is_literal_credential_url(col: Column) -> Column:
    return let(credential_url_password(col), lambda p: (p != "") & ~is_credential_template(p))


def _credential_like_segment(seg: Column) -> Column:
    return (
        (F.length(seg) >= fixed.MIN_CREDENTIAL_SEGMENT)
        & ~seg.rlike("[._-]")
        & seg.rlike("[a-z]") & seg.rlike("[A-Z]") & seg.rlike("[0-9]")
    )


def is_path_shaped(col: Column) -> Column:
    """Multi-segment file path, with an optional line locator and no credential-like segment."""
    bare = F.regexp_replace(col, fixed.PATH_LOCATOR, "")
    return col.rlike(fixed.PATH_SHAPE) & ~F.exists(F.split(bare, "/"), _credential_like_segment)


def is_jwt(col: Column) -> Column:
    """Header and payload decode to JSON objects and the header names an algorithm or the type."""
    def decoded(part: Column) -> Column:
        plain = F.regexp_replace(F.translate(part, "-_", "+/"), "=+$", "")
        padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
        return F.try_to_binary(padded, F.lit("base64")).cast("string")

    def text_of(part: Column) -> Column:
        return F.when(decoded(part).rlike(r"^\s*[{\[]"), decoded(part))

    parts = F.split(col, r"\.")
    return let(
        F.struct(
            text_of(F.get(parts, F.lit(0))).alias("head"),
            text_of(F.get(parts, F.lit(1))).alias("body"),
            F.get(parts, F.lit(2)).alias("sig"),
        ),
        lambda p: F.coalesce(
            (F.length(p.sig) >= 12)
            & F.try_parse_json(p.head).isNotNull()
            & F.try_parse_json(p.body).isNotNull()
            & (
                (F.schema_of_variant(F.try_variant_get(F.try_parse_json(p.head), "$.alg", "variant")) == "STRING")
                | (F.upper(F.try_variant_get(F.try_parse_json(p.head), "$.typ", "string")) == "JWT")
            ),
            F.lit(False),
        ),
    )


_PLAIN_SHAPES = "|".join(f"(?:{p})" for name, p, _, _ in fixed.KEY_SHAPES if name not in ("private-key", "jwt"))
_AWS_SECRET = "".join(fixed.AWS_SECRET[:2])
# literals of which one occurs in every plain shape
_SHAPE_HINT = "|".join(
    f"\\Q{a}\\E" for name, _, _, anchors in fixed.KEY_SHAPES if name not in ("private-key", "jwt") for a in anchors)


def holds_known_shape(col: Column) -> Column:
    """A key shape (other than a PEM block) occurs in the value and passes its own gate."""
    return (
        (col.rlike(_SHAPE_HINT) & col.rlike(java(_PLAIN_SHAPES)))
        | (col.rlike("(?i)secret") & col.rlike(java(_AWS_SECRET, True)))
        | F.exists(F.regexp_extract_all(col, F.lit(java(fixed.JWT)), F.lit(1)), is_jwt)
        | F.exists(F.regexp_extract_all(col, F.lit(java(fixed.CREDENTIAL_URL, True)), F.lit(1)), is_literal_credential_url)
    )


def _generic_secret(v: Column) -> Column:
    classes = sum(
        (v.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0)
    )
    return (
        ~v.rlike("(?i)" + fixed.STOP_VALUES)
        & ~is_path_shaped(v)
        & ~(v.rlike(fixed.SHORT_WORD) & (F.length(v) < 20))
        & ~v.rlike(fixed.IDENTIFIER_CHAIN)
        & ~(v.rlike(fixed.IDENTIFIER) & ~v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]"))
        & (classes >= 2)
        & (F.size(F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))) >= fixed.MIN_DISTINCT_CHARS)
    )


def likely_secret(col: Column) -> Column:
    """A generic assigned value looks like credential material rather than code, path or prose."""
    return let(
        trim_candidate(col),
        lambda v: F.when(
            (F.length(v) < fixed.MIN_SECRET_LEN) | (F.length(v) > fixed.MAX_SECRET_LEN) | is_placeholder(v), False
        )
        .when(credential_url_password(v) != "", is_literal_credential_url(v))
        .otherwise(_generic_secret(v) | holds_known_shape(v)),
    )


def luhn_valid(col: Column) -> Column:
    """13 to 19 digits, ignoring spaces and hyphens, with a valid check digit."""
    return let(
        F.regexp_replace(col, "[ -]", ""),
        lambda d: d.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", d),
    )


def is_case_expandable(col: Column) -> Column:
    """Word-like registry values may match in other letter cases; digit-bearing ones may not."""
    return ~col.rlike("[0-9]") & (F.length(F.regexp_replace(col, "[^A-Za-z]", "")) >= 2)


def is_lowercase_single_word(col: Column) -> Column:
    return let(
        trim_ws(col),
        lambda t: ~t.rlike(f"[{fixed.WS}]") & t.rlike(r"\p{L}") & (t == F.lower(t)),
    )


def is_name_word(col: Column) -> Column:
    """Connector, or a word whose letters are all upper case or start in upper case."""
    return let(
        F.struct(normalize_word(col).alias("n"), F.regexp_replace(col, r"[^\p{L}]", "").alias("letters")),
        lambda s: s.n.isin("and", "of", "the")
        | ((s.letters != "") & (
            # every cased letter is upper case and at least one is cased, or the first is upper case
            ((s.letters == F.upper(s.letters)) & (s.letters != F.lower(s.letters)))
            | s.letters.rlike(r"^[\p{Lu}]")
        )),
    )


def normalize_word(col: Column) -> Column:
    """Lower case without closing dots and apostrophes (text is NFKC-normalised on load)."""
    return F.regexp_replace(F.lower(col), "[.'’]+$", "")
