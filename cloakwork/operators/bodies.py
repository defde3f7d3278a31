"""JSON bodies inside their row: string literals with place, kind and path, and what their keys say about them.

One pass over the raw body.  A bracket stack follows the gaps between literals, so every literal gets
its steps (object keys and array indexes) whatever the depth: the plan is the same for flat and deep
bodies, and no row leaves its task.  The pass is a small Arrow function, because a fold of array
columns copies the stack for every bracket.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cloakwork.functions import fixed
from cloakwork.functions import predicates as P
from cloakwork.functions.text import JSON_LITERAL, let
from cloakwork.operators.spans import mark_safe

STEPS = "array<struct<key:string,index:int>>"
LITERAL = f"struct<at:int,at_end:int,kind:string,text:string,steps:{STEPS}>"
_LITERALS = T.ArrayType(T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("at_end", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("steps", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("index", T.IntegerType())])))]))
_STRING, _STRUCTURE, _NAMES = re.compile(JSON_LITERAL), re.compile(r"[\[\]{},]"), re.compile(r"[^\[\]{},:\"]*:")
_SURROGATE = re.compile("[\ud800-\udfff]")


def _decoded(literal: str) -> str:
    if "\\" not in literal:
        return literal[1:-1]
    # half of a surrogate pair has no UTF-8 form
    return _SURROGATE.sub("?", json.loads(literal, strict=False))


def _walk(body: str | None) -> list[tuple] | None:
    """Literals of one body, by a bracket stack; an object has a key on top of it, an array its index."""
    if body is None:
        return None
    out, stack, end = [], [], 0
    for m in _STRING.finditer(body):
        for c in _STRUCTURE.findall(body, end, m.start()):
            if c == "{":
                stack.append(("", -1))
            elif c == "[":
                stack.append((None, 0))
            elif c != ",":
                stack.pop()
            elif stack[-1][0] is None:
                stack[-1] = (None, stack[-1][1] + 1)
        end = m.end()
        text, names = _decoded(m.group(0)), _NAMES.match(body, end) is not None
        if names:
            stack[-1] = (text, -1)
        out.append((m.start(), end, "key" if names else "value", text, list(stack)))
    return out


@F.arrow_udf(_LITERALS)
def _walked(bodies: pa.Array) -> pa.Array:
    return pa.array([_walk(b) for b in bodies.to_pylist()], to_arrow_type(_LITERALS))


def literals(body: Column) -> Column:
    """``array<struct<at,at_end,kind,text,steps>>`` of a body in structural order.

    ``kind`` is key, value or raw: what is no JSON is one raw leaf.  ``steps`` of a key end in the
    key itself, steps of a value in the key or index that owns it.
    """
    raw = F.array(F.struct(F.lit(0).alias("at"), F.length(body).alias("at_end"), F.lit("raw").alias("kind"),
                           body.alias("text"), F.array().cast(STEPS).alias("steps")))
    valid = F.try_parse_json(body).isNotNull()
    return F.when(valid, _walked(F.when(valid, mark_safe(body)))).otherwise(raw.cast(f"array<{LITERAL}>"))


def path_of(steps: Column) -> Column:
    """JSON path of steps; keys that are no plain names stand quoted in brackets."""
    return F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda s: F.when(
        s["key"].isNull(), F.concat(F.lit("["), s["index"].cast("string"), F.lit("]")))
        .when(s["key"].rlike(fixed.SAFE_KEY), F.concat(F.lit("."), s["key"]))
        .otherwise(F.concat(F.lit("['"), F.regexp_replace(s["key"], r"([\\'])", r"\\$1"), F.lit("']")))), ""))


def owner_key(steps: Column) -> Column:
    """Key that owns a value: its own one, or that of the array it is a direct element of; else null."""
    top, outer = F.get(steps, F.size(steps) - 1), F.get(steps, F.size(steps) - 2)
    return F.coalesce(top["key"], outer["key"])


def owned_secret(text: Column) -> Column:
    """The secret that a string under a secret-ish key starts with, or null."""
    token = F.regexp_extract(text, fixed.LEADING_TOKEN, 1)
    return let(token, lambda t: F.when(P.likely_secret(t), let(P.trim_candidate(t), lambda v: F.when(
        (v != "") & ~P.is_placeholder(v), v))))


def structural_values(lits: Column, finding: str) -> Column:
    """Findings (``array`` of type ``finding``) of values that secret-ish keys own, by path."""
    guard = f"(?i)(?:{fixed.SECRET_WORD})"
    # most bodies have no such key: one look at the keys spares the rest
    named = F.exists(lits, lambda x: (x["kind"] == "key") & x["text"].rlike(guard))
    owned = F.filter(lits, lambda x: (x["kind"] == "value") & F.coalesce(owner_key(x["steps"]).rlike(guard), F.lit(False)))
    values = F.filter(F.transform(owned, lambda x: owned_secret(x["text"])), lambda v: v.isNotNull())
    none = F.lit(None).cast("int")
    return F.when(named, F.transform(values, lambda v: F.struct(
        F.lit("secret-json-value"), none, none, v, F.lit("secret"), F.lit("probabilistic"), F.lit("secret-shape"), F.lit(1.0))).cast(finding)
    ).otherwise(F.array().cast(finding))
