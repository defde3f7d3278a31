"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark windows, one scan per text.

Texts and items are normalised alike (A-Z lower-cased, words of letters, digits and characters
beyond ASCII, one blank between words).  Every window of an item - 10 consecutive words, or the whole
of a shorter item - is a pattern of the automaton, with a blank on either side so that it starts and
ends with words.  A task runs the automaton over each normalised text once and maps the hits back:
character in the normalised text -> word -> offsets in the original.  Only texts with a hit pay for
that map.

The automaton is built from the benchmark, not from the corpus.  Each task builds it once from its
patterns, which travel as a broadcast of checked size; a benchmark of more than ``PATTERN_BYTES`` is
cut into several automata by a hash of the window, each scanned by its own job, and the hits of a text are
put together again, so no benchmark is too large and no window is dropped.

Cases: null texts and items have no words; an item without words has no window; a null item id counts
as the id ``""``, and rows of one item id are one item; equal documents are documents of their own;
empty tables give no rows or no hits; texts are scanned whole; only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PATTERN_BYTES = 16_000_000     # normalised patterns of one automaton
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_CHARS = 4_000_000

_TO_LOWER = str.maketrans(UPPER, LOWER)
_BETWEEN = re.compile(BETWEEN)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: Column) -> Column:
    """Normalised words of a text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def windows(benchmark: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(pattern, items): the different windows of a benchmark and the ids of the items that hold them."""
    own = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    each = own.filter(F.size("w") > 0).select("item", "w", F.explode(starts).alias("at"))
    return each.select(F.array_join(F.slice("w", F.col("at"), width), " ").alias("pattern"), "item").groupBy("pattern").agg(
        F.sort_array(F.collect_set("item")).alias("items"))


# ----------------------------------------------------------------------------- tasks
def _automaton(patterns: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        out.add_word(f" {p} ", (len(p), i))
    out.make_automaton()
    return out


def find(automaton, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(number of words, hit word runs [first, behind the last) in order and apart, pattern numbers) of one text."""
    lowered = text.translate(_TO_LOWER)
    plain = f" {_BETWEEN.sub(' ', lowered).strip(' ')} "
    if plain == "  ":
        return 0, [], set()
    n, seen, spans = plain.count(" ") - 1, set(), []
    for end, (size, pattern) in automaton.iter(plain):
        seen.add(pattern)
        spans.append((end - size, end))          # characters of the window: the blank in front of it ends at end - size
    if not spans:
        return n, [], seen
    starts = [m.end() for m in re.finditer(" ", plain)][:-1]
    runs: list[tuple[int, int]] = []
    for first, behind in sorted((bisect_right(starts, a) - 1, bisect_right(starts, b - 1)) for a, b in spans):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(behind, runs[-1][1]))
        else:
            runs.append((first, behind))
    return n, runs, seen


def offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs as character spans of the original text (lower-casing A-Z keeps every offset)."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(_TO_LOWER))]
    return [{"first_word": a, "words": b - a, "start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("first_word", "words", "start", "end")])


def slices(batches: Iterator[pa.RecordBatch], column: int, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``chars`` bytes of text, so that long texts do not add up in a worker."""
    for batch in batches:
        size = batch.column(column)
        step = max(1, batch.num_rows * chars // max(size.nbytes, 1))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def _scan(table, arrow: pa.Schema, column: int):
    def run(batches):
        # the broadcast value lives as long as its worker, and so does the automaton built from it
        automaton = table.value.get("automaton") or table.value.setdefault("automaton", _automaton(table.value["patterns"]))
        items = table.value["items"]
        for batch in slices(batches, column):
            n_words, spans, found = [], [], []
            for text in batch.column(column).to_pylist():
                n, runs, seen = find(automaton, text or "") if items else (len(_WORD.findall((text or "").translate(_TO_LOWER))), [], set())
                n_words.append(n)
                spans.append(offsets(text, runs) if runs else [])
                found.append(sorted(set().union(*(items[p] for p in seen))) if seen else [])
            new = [pa.array(n_words, pa.int64()), pa.array(spans, arrow.field("spans").type),
                   pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return run


def _tables(benchmark: DataFrame, width: int, id_col: str, text_col: str, pattern_bytes: int) -> Iterator[dict]:
    """Patterns and their items, one table of bounded size after the other."""
    found = windows(benchmark, width, id_col, text_col)
    size = found.agg(F.sum(F.octet_length("pattern") + F.octet_length(F.array_join("items", ","))).alias("bytes")).first()["bytes"] or 0
    shards = -(-size // pattern_bytes) or 1
    for k in range(shards):
        rows = found.filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k).collect()     # at most about pattern_bytes
        yield {"patterns": [r["pattern"] for r in rows], "items": [r["items"] for r in rows]}


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """doc_id, text, n_words, spans (first_word, words, start, end in the text), items of every document.

    Spans are the runs of words that windows cover, in order and apart.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)),
                           T.StructField("items", T.ArrayType(T.StringType()))])
    share = docs.sparkSession.sparkContext.broadcast        # writes the table out: the driver holds one at a time
    scans = [rows.mapInArrow(_scan(share(t), to_arrow_schema(schema), 1), schema)
             for t in _tables(benchmark, width, item_col, item_text_col, pattern_bytes)]
    return scans[0] if len(scans) == 1 else _together(scans)


def _together(scans: list[DataFrame]) -> DataFrame:
    """Hits of several automata on the same texts: spans united, items once."""
    hit = scans[0].withColumn("_again", F.lit(0))
    for k, s in enumerate(scans[1:], 1):
        # behind the first automaton only texts with a hit are of interest
        hit = hit.unionByName(s.filter(F.size("spans") > 0).withColumn("_again", F.lit(k)))
    one = hit.withColumn("_text", F.unhex(F.sha2("text", 256)))
    # equal rows (id and text) have equal hits, so they may share a group: their number is kept
    merged = one.groupBy("doc_id", "_text").agg(
        F.first("text").alias("text"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("_again") == 0).cast("int").alias("_n"))
    ordered = F.array_sort("spans")

    def united(spans: Column) -> Column:
        none = F.array().cast(T.ArrayType(SPAN))

        def add(out: Column, s: Column) -> Column:
            last = F.try_element_at(out, F.lit(-1))
            behind = last["first_word"] + last["words"]
            words = F.greatest(behind, s["first_word"] + s["words"]) - last["first_word"]
            joint = F.struct(last["first_word"], words, last["start"], F.greatest(last["end"], s["end"])).cast(SPAN)
            return F.when((F.size(out) > 0) & (s["first_word"] <= behind), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joint))).otherwise(
                F.concat(out, F.array(s)))

        return F.aggregate(spans, none, add)

    return merged.select("doc_id", "text", "n_words", united(ordered).alias("spans"), "items", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_c")).drop("_c")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id and the text with its hit spans cut out; texts without a hit stay as they are."""
    out = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s.end))
    starts = F.concat(F.transform("spans", lambda s: s.start), F.array(F.length("text").cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(
        F.col("text"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))), "")
    return out.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(kept).alias("text"))


def verdicts(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every document."""
    out = leaks(docs, benchmark, **how)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.words)
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")
