"""Keep values that are only part of a file path readable (columns, usable inside lambdas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.text import let

# A text without any of these cannot hold a path-like token or a path operand.
PATH_HINT = r"[/\\]|(?:cd|pushd|-C|-chdir|--cwd|--workdir|--directory)[=\s\x{A0}\x{2000}-\x{3000}]"


def path_kind(token: Column) -> Column:
    """``explicit``, ``relative`` or null for one whitespace/punctuation-bounded token."""
    value = F.regexp_replace(F.regexp_replace(token, "^[=:]+", ""), "[.:]+$", "")
    return let(value, lambda v: F.when(
        v.rlike("[A-Za-z][A-Za-z0-9+.-]*://"),
        F.when(F.lower(F.regexp_extract(v, "([A-Za-z][A-Za-z0-9+.-]*://)", 1)).startswith("file://"), "explicit"),
    ).when(v.rlike(r"^(?:/|~/|\./|\.\./)") | v.rlike(r"^[A-Za-z]:[\\/]"), "explicit")
     .when(v.rlike(r"[/\\]"), "relative"))


def preserved(text: Column, start: Column, end: Column, value: Column) -> Column:
    """The occurrence sits in a path-like token or path operand that must stay readable."""
    outside = f"[^{fixed.TOKEN_BOUNDARY}]"
    left = F.substring(text, F.lit(1), start)
    right = F.substring(text, end + 1, F.length(text))

    def judged(c: Column) -> Column:
        before = F.substring(c.left, F.lit(1), F.length(c.left) - F.length(c.head))
        # cut at the last delimiter: one anchored greedy run, so the cost stays in proportion to the line
        segment = F.regexp_replace(F.regexp_replace(before, r"(?s)^.*[\n;|&]", ""), "[\"'`]++$", "")
        kind = path_kind(F.concat(c.head, value, c.tail))
        shell = segment.rlike(fixed.SHELL_PATH_OPERAND)
        return let(
            F.struct(kind.alias("kind"), shell.alias("shell"), before.endswith("=").alias("assigned")),
            lambda k: F.coalesce(
                (k.kind.isNotNull() | k.shell)
                & (value.rlike(fixed.SIMPLE_SEGMENT) | k.shell | ((k.kind == "explicit") & ~k.assigned)),
                F.lit(False),
            ),
        )

    return let(
        F.struct(
            left.alias("left"),
            F.regexp_replace(left, rf"(?s)^.*[{fixed.TOKEN_BOUNDARY}]", "").alias("head"),
            F.regexp_extract(right, f"^({outside}*+)", 1).alias("tail"),
        ),
        judged,
    )
