"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a key that depends on its id alone.  Within its source the documents stand
in key order; the key space is cut into equal ranges, so a source that holds a third of all rows
spreads over as many tasks as its rows need.  Prefix sums come from range totals plus a running
sum inside each range, and a source is cut at exactly its budget: whole epochs first, then the
rest in key order, the document at the cut in part.

Cases: null texts have size 0; a null source is a source, ordered last; null ids share a key;
repeated rows are documents of their own (equal rows are interchangeable); an empty table gives
an empty mix; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import WORD, written

RANGE_ROWS = 2000


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """id, source, size and the hash-random key of each document."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Word budgets per source (source, source_size -> target).

    Sources by code point, null last, take the weights in turn.  ``share`` of all words is dealt by
    weight; a target stops at ``most`` times its source, and the excess goes to the others by weight.
    The level at which this ends is found by one pass in the order in which sources fill up.
    The input has one row per source, never per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    open_level = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    final = F.first(open_level, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (named.withColumn("level", level).withColumn("final", final)
            .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))))
            .select("source", "source_size", "target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the document in the mix, repeats counted)."""
    base = written(sizes(docs, id_col, source_col, text_col), "mix")
    ranges = max(1, -(-base.count() // range_rows))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")
    placed = base.withColumn("part", at)
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    budget = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(up_to), F.lit(0)))
    known = offsets.alias("o").join(budget.alias("b"), F.col("o.source").eqNullSafe(F.col("b.source"))).select(
        F.col("o.source").alias("of"), F.col("part").alias("at"), "offset", "source_size", "target")
    joined = placed.join(known, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    inside = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("full") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("offset") + F.col("running") - F.col("size"))))
    return (joined.withColumn("running", running).withColumn("full", full).withColumn("rest", rest)
            .select("doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + part).cast("long").alias("taken")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word: cut where words end, keep the first pieces."""
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    return F.array_join(F.slice(F.split(text, ends), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix as documents: a row per copy, in the columns given; the copy at the cut keeps its first words only.

    A text with no word stays in the mix once.
    """
    taken = mix(docs, id_col, source_col, text_col, **how)
    # rows of one id, source and size are numbered on both sides; which of them takes which share is all one
    same = Window.partitionBy("doc_id", "source", "size").orderBy("taken")
    numbered = taken.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.row_number().over(same).alias("_mix_no"),
                            F.struct("size", "taken").alias("_mix"))
    here = docs.withColumn("_row_size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    here = here.withColumn("_row_no", F.row_number().over(Window.partitionBy(id_col, source_col, "_row_size").orderBy(F.xxhash64(text_col))))
    both = here.join(numbered, F.col(id_col).eqNullSafe(F.col("_mix_id")) & F.col(source_col).eqNullSafe(F.col("_mix_source"))
                     & (F.col("_row_size") == F.col("_mix.size")) & (F.col("_row_no") == F.col("_mix_no")))
    size, words = F.col("_mix.size"), F.col("_mix.taken")
    whole = F.when(size == 0, F.lit(1)).otherwise(F.floor(words / size)).cast("int")
    cut = F.when(size == 0, F.lit(0)).otherwise(words % size)
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(cut > 0, F.array(cut.cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = both.withColumn("_mix_cut", F.explode(copies))
    text = F.when(F.col("_mix_cut") > 0, first_words(F.col(text_col), F.col("_mix_cut"))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
