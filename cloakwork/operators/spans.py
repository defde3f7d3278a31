"""Spans inside texts: scan, overlap, resolve, select, splice.

Offsets are 0-based code points, half open.  Texts stay on their row: a scan yields an
array column, so detection, resolution and splicing of ordinary documents need no shuffle.
The relational twins (``*_rows``) serve span tables of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from cloakwork.functions import fixed
from cloakwork.functions.text import let

MARK = "\u0001"
_STAND_IN = "\u0002"
_SMALL_SPLICE = 64    # spans up to which cutting by position beats cutting a character array


def mark_safe(text: Column) -> Column:
    """Text in which the mark character cannot occur (same length)."""
    return F.when(text.contains(MARK), F.translate(text, MARK, _STAND_IN)).otherwise(text)


def cut(text: Column, pattern: Column | str, replacement: str = f"{MARK}$1{MARK}") -> Column:
    """Pieces of ``text``: odd ones are matches.  ``text`` must be mark-safe."""
    return F.split(F.regexp_replace(text, pattern, F.lit(replacement)), MARK, -1)


def running(values: Column, op, body) -> Column:
    """Bind a running fold of an integer array: ``body(at)`` where ``at(i)`` folds the first ``i`` values.

    Sums of blocks of 16 and of 256 are kept beside the values, so one look-up folds a few short
    slices.  (A fold that grows an array instead would copy that array at each step.)
    """
    def fold(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), op)

    def blocks(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.transform(
            F.sequence(F.lit(0), ((F.size(x) - 1) / 16).cast("int")), lambda k: fold(F.slice(x, k * 16 + 1, 16))
        )).otherwise(F.array().cast("array<int>"))

    def level(x: Column) -> Column:
        return let(x, lambda v: let(blocks(v), lambda one: let(blocks(one), lambda two: bound(v, one, two))))

    def bound(v: Column, one: Column, two: Column) -> Column:
        def at(i: Column) -> Column:
            low, mid, high = F.shiftright(i, 4), F.shiftright(i, 8), i
            return op(op(
                fold(F.slice(two, F.lit(1), mid)),
                fold(F.slice(one, mid * 16 + 1, low - mid * 16))),
                fold(F.slice(v, low * 16 + 1, high - low * 16)))
        return body(at)

    return level(values)


def pieces_to_spans(pieces: Column) -> Column:
    """array<struct<start,end,value>> of the odd pieces."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def whole(p: Column) -> Column:
        return running(F.transform(p, lambda x: F.length(x)), lambda a, w: a + w, lambda at: F.transform(
            F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)),
            lambda i: let(at(i), lambda s: F.struct(
                s.alias("start"), (s + F.length(F.get(p, i))).alias("end"), F.get(p, i).alias("value"))),
        ))

    return let(pieces, lambda p: F.when(F.size(p) > 1, whole(p)).otherwise(none))


def scan(text: Column, pattern: Column | str, replacement: str = f"{MARK}$1{MARK}") -> Column:
    """Spans of one pattern in one text."""
    return pieces_to_spans(cut(text, pattern, replacement))


# ------------------------------------------------- columns with many spans a text
_SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))
_SLICE = 1_000_000    # pieces, or characters, that one step holds beside its batch


def _row_slices(weights: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive rows ``(first, behind)`` of about ``_SLICE`` together; a row is never cut."""
    part = np.cumsum(weights) // _SLICE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(weights)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _lengths(texts: pa.Array, op=pc.utf8_length) -> np.ndarray:
    return pc.fill_null(op(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _before(counts: np.ndarray) -> np.ndarray:
    """Running sum in front of each place, and the total behind the last one."""
    return np.concatenate([[0], np.cumsum(counts)])


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and where each begins (and the last ends)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def _strings(begin: np.ndarray, size: np.ndarray, source: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(
        len(size), pa.py_buffer(_before(size).astype(np.int32)), pa.py_buffer(_ragged(source, begin, size)))


def _between_marks(marked: pa.Array) -> pa.Array:
    raw, at = _raw(marked)
    marks = np.flatnonzero(raw == ord(MARK))
    # characters in front of each byte, marks apart
    chars = _before(((raw & 0xC0) != 0x80) & (raw != ord(MARK)))
    left, right = marks[::2], marks[1::2]
    n = np.diff(np.searchsorted(left, at))
    base = np.repeat(chars[at[:-1]], n)
    kinds = to_arrow_type(_SPANS)
    spans = pa.StructArray.from_arrays(
        [pa.array(chars[left] - base, pa.int32()), pa.array(chars[right] - base, pa.int32()),
         _strings(left + 1, right - left - 1, raw)], fields=list(kinds.value_type))
    return pa.ListArray.from_arrays(pa.array(_before(n), pa.int32()), spans, type=kinds)


# spans take several times the room of their texts, so each slice of a batch goes back by itself
@F.arrow_udf(_SPANS)
def _located(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for marked in batches:
        for a, b in _row_slices(_lengths(marked, pc.binary_length)):
            yield _between_marks(marked.slice(a, b - a))


def scan_many(text: Column, pattern: Column | str, replacement: str = f"{MARK}$1{MARK}") -> Column:
    """Like :func:`scan`, for a text column with hundreds of spans a row (no lambda can hold it).

    Offsets are running sums over the marked texts of a batch, so a span costs the same in long and short texts.
    """
    return _located(F.regexp_replace(text, pattern, F.lit(replacement)))


def _ragged(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``source[start : start + size]`` behind one another."""
    return source[np.repeat(start - _before(size)[:-1], size) + np.arange(int(size.sum()))]


def _spliced(text: str | None, starts: list[int] | None, ends: list[int] | None, tokens: list[str] | None) -> str | None:
    if text is None or starts is None:
        return None
    spans = [(s or 0, e or 0, t or "") for s, e, t in zip(starts, ends, tokens)]
    if any(b[0] <= a[0] for a, b in zip(spans, spans[1:])):
        spans.sort()
    out, at = [], 0
    for start, end, token in spans:
        out += text[at:start], token
        at = end
    return "".join(out) + text[at:]


# row by row on purpose: an Arrow batch of 10,000 texts with all their spans takes many times the room of the texts,
# in the JVM and in Python; here 100 rows travel at a time
_splice_rows = F.udf(_spliced, T.StringType(), useArrow=False)


def splice_many(text: Column, spans: Column, token) -> Column:
    """Like :func:`splice`, for a text column with hundreds of spans a row (no lambda can hold it)."""
    return _splice_rows(text, spans["start"], spans["end"], F.transform(spans, token))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals intersect."""
    return (a_start < b_end) & (b_start < a_end)


# --------------------------------------------------------------------- J10
def span_overlap_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                      width: int = 64) -> DataFrame:
    """Join spans of the same key that overlap.

    Both sides carry ``start``/``end``; right-hand ones come back as ``r_start``/``r_end``.
    Offsets are bucketed, so one huge key spreads over many partitions and each pair is
    compared in exactly one bucket (the later of the two starts).
    """
    def bucketed(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn(
            "_bucket",
            F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))),
        )

    r = right.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    r = r.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    lb = bucketed(left.withColumn("_row", F.monotonically_increasing_id()) if how == "left_anti" else left,
                  "start", "end")
    rb = bucketed(r, "r_start", "r_end").withColumnRenamed("_bucket", "_r_bucket")
    cond = (F.col("_bucket") == F.col("_r_bucket")) & overlaps(
        F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")
    )
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    drop = ["_bucket", "_r_bucket"] + [f"_r_{k}" for k in keys]
    if how == "inner":
        once = F.col("_bucket") == F.floor(F.greatest("start", "r_start") / width)
        return lb.join(rb, cond & once).drop(*drop)
    raise ValueError("use semi_overlap for semi and anti joins")


def semi_overlap(left: DataFrame, right: DataFrame, keys: list[str], anti: bool = False,
                 width: int = 64) -> DataFrame:
    """Rows of ``left`` that overlap (``anti``: do not overlap) some span of ``right``."""
    spans = left.select(*keys, "start", "end").distinct()
    hit = span_overlap_join(spans, right.select(*keys, "start", "end").distinct(), keys, width=width)
    hit = hit.select(*keys, "start", "end").distinct()
    return left.join(hit, [*keys, "start", "end"], "left_anti" if anti else "left_semi")


# ----------------------------------------------------------------------- W1
# Order in which claims win: registry authority, confidence, longer, earlier, then names.
AUTHORITY = {"registry": 2, "detected": 1}
CONFIDENCE = {"exact": 3, "high": 2, "probabilistic": 1}
ORIGIN = {"detector": 3, "expansion": 2, "clipped": 1}
CLAIM_DEFAULTS = {
    "authority": "detected", "confidence": "probabilistic", "source": "", "entity_id": "",
    "detection_source": "detector", "link_source": "none", "link_confidence": "", "origin": "detector",
}


def rank_of(col: Column, ranks: dict[str, int], default: int = 1) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in ranks.items():
        out = out.when(col == name, F.lit(rank))
    return out.otherwise(F.lit(default))


def priority(start: Column, end: Column, value: Column, field) -> Column:
    """Sortable struct; the least one wins.  ``field`` maps an attribute name to its column."""
    return F.struct(
        (-rank_of(field("authority"), AUTHORITY)).alias("p_authority"),
        (-rank_of(field("confidence"), CONFIDENCE)).alias("p_confidence"),
        (start - end).alias("p_length"),
        start.alias("p_start"),
        field("source").alias("p_source"),
        field("entity_id").alias("p_entity"),
        field("detection_source").alias("p_detection"),
        field("link_source").alias("p_link"),
        field("link_confidence").alias("p_link_confidence"),
        (-rank_of(field("origin"), ORIGIN)).alias("p_origin"),
        value.alias("p_value"),
    )


def _trimmed(surface: Column, start: Column) -> Column:
    """Span of a clipped remainder without its edge white space."""
    head = F.regexp_replace(surface, rf"^[{fixed.WS}]+", "")
    return let(
        F.struct(head.alias("head"), F.regexp_replace(head, rf"[{fixed.WS}]+$", "").alias("core"), surface.alias("all")),
        lambda t: F.struct(
            (start + F.length(t["all"]) - F.length(t["head"])).alias("start"),
            (start + F.length(t["all"]) - F.length(t["head"]) + F.length(t["core"])).alias("end"),
            t["core"].alias("value"),
        ),
    )


def islands(claims: Column) -> Column:
    """Split the different claims into runs, in order of start, that touch no claim outside the run."""
    ordered = let(
        F.sort_array(F.transform(claims, lambda x: F.struct(x.start.alias("s"), x.end.alias("e"), x.alias("x")))),
        # equal claims stand side by side and count once
        lambda k: F.transform(F.filter(k, lambda y, i: (i == 0) | ~y.eqNullSafe(F.get(k, i - 1))), lambda y: y.x))

    def split(c: Column) -> Column:
        return running(F.transform(c, lambda x: x.end), lambda a, e: F.greatest(a, e), lambda reach: let(
            F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i).start >= reach(i))),
            lambda first: F.transform(first, lambda a, n: F.slice(
                c, a + 1, F.coalesce(F.get(first, n + 1), F.size(c)) - a)),
        ))

    return let(ordered, split)


def _owners(c: Column, b: Column) -> Column:
    """Index of the best claim over each elementary segment of an island (null: none); ``b`` has the sorted boundaries.

    Segments go in blocks of about the square root of their number.  A block looks at all claims
    once: of those that cover it whole only the best can win, the others have an end inside it.
    """
    spans = F.transform(c, lambda x, i: F.struct(i.alias("i"), x.start.alias("s"), x.end.alias("e")))

    def of(g: Column) -> Column:
        n, width = F.size(b) - 1, g["width"]

        def block(k: Column) -> Column:
            first, behind = k * width, F.least((k + 1) * width, n)
            low, high = F.get(b, first), F.get(b, behind)
            cover = F.get(F.filter(g["spans"], lambda x: (x["s"] <= low) & (x["e"] >= high)), F.lit(0))["i"]
            return let(F.struct(first.alias("first"), behind.alias("behind"), low.alias("low"), high.alias("high"), cover.alias("cover")), lambda q: let(
                F.filter(g["spans"], lambda x: (x["s"] < q["high"]) & (x["e"] > q["low"])
                         & (~((x["s"] <= q["low"]) & (x["e"] >= q["high"])) | (x["i"] == q["cover"]))),
                lambda near: F.transform(F.sequence(q["first"], q["behind"] - 1), lambda j: F.get(F.filter(
                    near, lambda x: (x["s"] <= F.get(b, j)) & (x["e"] >= F.get(b, j + 1))), F.lit(0))["i"])))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), block))

    width = F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(b).cast("double"))).cast("int"))
    return let(F.struct(spans.alias("spans"), width.alias("width")), of)


def _resolve_island(c: Column) -> Column:
    """Owners of one island; ``c`` is sorted by priority and bound."""
    registry = -AUTHORITY["registry"]

    def runs(b: Column, o: Column, st: Column) -> Column:
        # a registered claim owns every segment it covers that no other registered one owns, so a
        # detected claim is beaten by the registry where some of its segments have such an owner
        owned = F.transform(o, lambda i: (F.get(c, i).pri.p_authority == registry).cast("int"))
        return running(F.transform(owned, lambda x: F.coalesce(x, F.lit(0))), lambda a, w: a + w, lambda at: found(b, st, o, at))

    def found(b: Column, st: Column, o: Column, at) -> Column:
        return F.transform(
            F.filter(
                F.transform(st, lambda k, n: F.struct(
                    F.get(o, k).alias("i"), F.get(b, k).alias("s"),
                    F.get(b, F.coalesce(F.get(st, n + 1), F.size(b) - 1)).alias("e"),
                )),
                lambda r: r.i.isNotNull(),
            ),
            lambda r: finish(r, F.get(c, r.i), b, at),
        )

    def finish(r: Column, owner: Column, b: Column, at) -> Column:
        def build(x: Column) -> Column:
            clipped = (r.s != x.start) | (r.e != x.end)
            kept = F.when(
                clipped, _trimmed(F.substring(x.value, r.s - x.start + 1, r.e - r.s), r.s)
            ).otherwise(F.struct(x.start.alias("start"), x.end.alias("end"), x.value.alias("value")))
            place = lambda v: (F.array_position(b, v) - 1).cast("int")
            by_registry = (x.pri.p_authority == registry) | (at(place(x.end)) > at(place(x.start)))
            return let(kept, lambda k: F.struct(
                k.start.alias("start"), k.end.alias("end"), k.value.alias("value"),
                (clipped | (x.pri.p_origin == -ORIGIN["clipped"])).alias("clipped"),
                F.when(clipped, F.when(by_registry, "registry").otherwise("detected")).alias("clipped_by"),
                x.info.alias("info"),
            ))
        return let(owner, build)

    bounds = F.sort_array(F.array_distinct(F.concat(
        F.transform(c, lambda x: x.start), F.transform(c, lambda x: x.end))))
    return let(bounds, lambda b: let(
        _owners(c, b),
        lambda o: let(
            F.filter(
                F.sequence(F.lit(0), F.size(o) - 1),
                lambda k: (k == 0) | ~F.get(o, k).eqNullSafe(F.get(o, k - 1)),
            ),
            lambda st: runs(b, o, st),
        ),
    ))


def resolve_array(claims: Column) -> Column:
    """Resolve overlapping claims of one text inside its row.

    ``claims`` is ``array<struct<pri, start, end, value, info>>`` where ``pri`` comes from
    :func:`priority`.  Every claimed character gets exactly one owner; losers keep their
    remainders.  Returns ``array<struct<start,end,value,clipped,clipped_by,info>>``.
    """
    def plain(c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(
            x.start.alias("start"), x.end.alias("end"), x.value.alias("value"),
            (x.pri.p_origin == -ORIGIN["clipped"]).alias("clipped"),
            F.lit(None).cast("string").alias("clipped_by"), x.info.alias("info")))

    many = F.flatten(F.transform(
        islands(claims),
        lambda isle: F.when(F.size(isle) == 1, plain(isle)).otherwise(let(F.sort_array(isle), _resolve_island)),
    ))
    return F.when(F.size(claims) <= 1, plain(claims)).otherwise(F.filter(many, lambda r: r.end > r.start))


def dyadic_cover(first: Column, behind: Column) -> Column:
    """``array<struct<level,node>>``: the fewest runs ``[node * 2^level, (node + 1) * 2^level)`` that make up ``[first, behind)``."""
    kind = "array<struct<level:int,node:int>>"
    start = F.struct(first.cast("int").alias("l"), behind.cast("int").alias("r"), F.array().cast(kind).alias("out"))

    def run(k: Column, node: Column, wanted: Column) -> Column:
        return F.when(wanted, F.array(F.struct(k.alias("level"), node.alias("node"))).cast(kind)).otherwise(F.array().cast(kind))

    def step(a: Column, k: Column) -> Column:
        left, right = (a["l"] < a["r"]) & (a["l"] % 2 == 1), (a["l"] < a["r"]) & (a["r"] % 2 == 1)
        return F.struct(
            F.shiftright(a["l"] + left.cast("int"), 1).alias("l"), F.shiftright(a["r"], 1).alias("r"),
            F.concat(a["out"], run(k, a["l"], left), run(k, a["r"] - 1, right & (a["l"] + left.cast("int") < a["r"]))).alias("out"))

    levels = F.sequence(F.lit(0), F.ceil(F.log2((behind + 1).cast("double"))).cast("int"))
    return F.aggregate(levels, start, step, lambda a: a["out"])


def resolve_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Resolve overlapping claims given as rows ``(keys, start, end, value, attributes…)``.

    Claims are first cut into islands of touching spans (one window over the text key);
    islands of a single claim pass straight through, the others are cut at all their
    boundaries.  Only spans move between tasks, never texts.
    """
    attrs = list(CLAIM_DEFAULTS)
    base = df
    for name, default in CLAIM_DEFAULTS.items():
        if name not in base.columns:
            base = base.withColumn(name, F.lit(default))
    extra = [c for c in base.columns if c not in {*keys, "start", "end", "value", *attrs}]
    base = base.select(*keys, "start", "end", "value", *attrs, *extra).distinct()
    base = base.withColumn("pri", priority(F.col("start"), F.col("end"), F.col("value"), F.col))

    in_text = W.partitionBy(*keys).orderBy("start", "end")
    before = in_text.rowsBetween(W.unboundedPreceding, -1)
    base = base.withColumn("_new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    base = base.withColumn("_island", F.sum("_new").over(in_text.rowsBetween(W.unboundedPreceding, 0)))
    island = [*keys, "_island"]
    base = base.withColumn("_n", F.count("*").over(W.partitionBy(*island))).drop("_new")

    carried = [*keys, "start", "end", "value", *attrs, *extra]
    lone = base.filter("_n = 1").select(
        *carried, (F.col("origin") == "clipped").alias("clipped"), F.lit(None).cast("string").alias("clipped_by")
    )
    # inside an island a claim is its rank: surfaces and attributes come back at the end
    shared = base.filter("_n > 1").withColumn("_rank", F.row_number().over(W.partitionBy(*island).orderBy("pri")))
    registered = F.col("pri.p_authority") == -AUTHORITY["registry"]
    slim = shared.select(*island, "_rank", "start", "end", registered.alias("_reg"))
    at = W.partitionBy(*island).orderBy("s")
    cuts = slim.select(*island, F.explode(F.array("start", "end")).alias("s")).distinct()
    segments = cuts.withColumn("e", F.lead("s").over(at)).withColumn("i", F.row_number().over(at) - 1)
    place = segments.select(*island, "s", "i")
    placed = slim.join(place.withColumnsRenamed({"s": "start", "i": "_from"}), [*island, "start"]).join(
        place.withColumnsRenamed({"s": "end", "i": "_to"}), [*island, "end"]).select(*island, "_rank", "_reg", "_from", "_to")
    # a claim is few dyadic runs of segments, a segment lies in one run of each length: neither meets all of the other
    covered = placed.select(*island, "_rank", "_reg", F.explode(dyadic_cover(F.col("_from"), F.col("_to"))).alias("d"))
    best = covered.groupBy(*island, "d.level", "d.node").agg(F.min(F.struct("_rank", "_reg")).alias("best"))
    levels = F.ceil(F.log2(F.max("i").over(W.partitionBy(*island)) + 1)).cast("int")
    up = segments.withColumn("_levels", levels).filter("e is not null").select(
        *island, "s", "e", "i", "_levels", F.explode(F.sequence(F.lit(0), F.col("_levels"))).alias("level")).withColumn("node", F.expr("shiftright(i, level)"))
    owned = up.join(best, [*island, "level", "node"]).groupBy(*island, "s", "e", "i", "_levels").agg(F.min("best").alias("best")).select(
        *island, "s", "e", "i", "_levels", "best._rank", "best._reg")
    by_s = W.partitionBy(*island).orderBy("s")
    first = F.coalesce((F.lag("_rank").over(by_s) != F.col("_rank")) | (F.lag("e").over(by_s) != F.col("s")), F.lit(True))
    runs = owned.withColumn("_run", F.sum(first.cast("int")).over(by_s)).groupBy(*island, "_run", "_rank", "_reg").agg(
        F.min("s").alias("s"), F.max("e").alias("e"))
    # registered claims own all they cover, so a detected one is beaten by the registry where one owns a segment of it
    marks = owned.filter("_reg").select(*island, F.explode(F.transform(
        F.sequence(F.lit(0), F.col("_levels")), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("i"), k).alias("node")))).alias("m")
    ).select(*island, "m.level", "m.node").distinct()
    beaten = covered.filter("not _reg").select(*island, "_rank", "d.level", "d.node").join(marks, [*island, "level", "node"]).select(
        *island, "_rank").distinct().withColumn("_by", F.lit(True))
    claims = shared.select(*island, "_rank", "start", "end", "value", *attrs, *extra)
    cut_now = (F.col("s") != F.col("start")) | (F.col("e") != F.col("end"))
    surface = F.substring("value", F.col("s") - F.col("start") + 1, F.col("e") - F.col("s"))
    kept = F.when(cut_now, _trimmed(surface, F.col("s"))).otherwise(F.struct("start", "end", "value"))
    mixed = (
        runs.join(claims, [*island, "_rank"]).join(beaten, [*island, "_rank"], "left")
        .withColumn("_kept", kept)
        .filter("_kept.end > _kept.start")
        .select(
            *keys, "_kept.start", "_kept.end", "_kept.value", *attrs, *extra,
            (cut_now | (F.col("origin") == "clipped")).alias("clipped"),
            F.when(cut_now, F.when(F.col("_reg") | F.col("_by"), "registry").otherwise("detected")).alias("clipped_by"),
        )
    )
    out = lone.unionByName(mixed)
    return out.withColumn("origin", F.when(F.col("clipped"), "clipped").otherwise(F.col("origin")))


# ----------------------------------------------------------------------- W2
def longest_first(spans: Column) -> Column:
    """Longest values first, then left to right; a span touching a chosen one is dropped whole.

    The choice is made inside each island of touching spans; islands do not influence each other.
    """
    def choose(isle: Column) -> Column:
        ordered = F.sort_array(F.transform(isle, lambda s: F.struct(
            (-F.length(s.pattern_value)).alias("neg"), s.pattern_value.alias("pv"), s.start.alias("start"), s.alias("span"))))
        return F.aggregate(
            ordered,
            F.filter(isle, lambda s: F.lit(False)),
            lambda acc, o: F.when(
                F.exists(acc, lambda x: overlaps(x.start, x.end, o.span.start, o.span.end)), acc
            ).otherwise(F.concat(acc, F.array(o.span))),
        )

    many = F.flatten(F.transform(islands(spans), lambda isle: F.when(F.size(isle) == 1, isle).otherwise(choose(isle))))
    return F.when(F.size(spans) <= 1, spans).otherwise(F.sort_array(many))


# ----------------------------------------------------------------------- W3
def splice(text: Column, spans: Column, token) -> Column:
    """Replace non-overlapping spans (``array<struct<start,end,…>>``) by ``token(span)``."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s.start.alias("start"), s.end.alias("end"), token(s).alias("token"))))

    def by_position(o: Column) -> Column:
        parts = F.transform(o, lambda s, i: F.concat(
            let(F.when(i == 0, F.lit(0)).otherwise(F.get(o, i - 1)["end"]),
                lambda prev: F.substring(text, prev + 1, s.start - prev)),
            s.token,
        ))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.get(o, F.size(o) - 1)["end"] + 1, F.length(text)))

    def by_characters(o: Column) -> Column:
        return let(F.split(text, ""), lambda chars: F.concat(
            F.array_join(F.flatten(F.transform(o, lambda s, i: F.concat(
                let(F.when(i == 0, F.lit(0)).otherwise(F.get(o, i - 1)["end"]),
                    lambda prev: F.slice(chars, prev + 1, s.start - prev)),
                F.array(s.token),
            ))), ""),
            let(F.get(o, F.size(o) - 1)["end"], lambda last: F.array_join(
                F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), "")),
        ))

    return F.when(F.size(spans) == 0, text).otherwise(
        let(ordered, lambda o: F.when(F.size(o) <= _SMALL_SPLICE, by_position(o)).otherwise(by_characters(o)))
    )


def anchors_hold(text: Column, spans: Column) -> Column:
    """Every span re-anchors to its value and no two overlap (the splice precondition)."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s.start, s.end, s.value)))
    return let(ordered, lambda o: ~F.exists(
        F.transform(o, lambda s, i: F.struct(
            s.alias("s"), F.when(i == 0, F.lit(0)).otherwise(F.get(o, i - 1)["end"]).alias("prev"))),
        lambda p: (p.s.start < p.prev) | (F.substring(text, p.s.start + 1, p.s.end - p.s.start) != p.s.value),
    ))


# ----------------------------------------------------------------------- J4
def map_joined_offsets(spans: DataFrame, leaves: DataFrame, keys: list[str], order: str = "leaf") -> DataFrame:
    """Spans on the newline-joined view of a document's leaves, mapped back to each leaf.

    A span that crosses a separator is split and marked ``clipped``; the separator itself is
    never covered.
    """
    ordered = W.partitionBy(*keys).orderBy(order)
    placed = leaves.withColumn(
        "base",
        F.coalesce(F.sum(F.length("text") + 1).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("leaf_end", F.col("base") + F.length("text"))
    hit = spans.join(placed, keys).filter(
        overlaps(F.col("start"), F.col("end"), F.col("base"), F.col("leaf_end"))
    )
    s, e = F.greatest("start", "base"), F.least("end", "leaf_end")
    total = F.sum(e - s).over(W.partitionBy(*keys, "start", "end"))
    return hit.select(
        *keys, order,
        F.col("start").alias("joined_start"), F.col("end").alias("joined_end"),
        (s - F.col("base")).alias("start"), (e - F.col("base")).alias("end"),
        F.substring(F.col("text"), (s - F.col("base") + 1).cast("int"), (e - s).cast("int")).alias("value"),
        (total != F.col("end") - F.col("start")).alias("clipped"),
    )
