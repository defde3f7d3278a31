"""Substring deduplication by level-wise doubling.

A window of ``size`` words that repeats across documents has repeating windows of half the length
inside.  So the first level looks at windows of half the length (two of them, sharing one word at
most, make a whole window), and only those that repeat are extended to twice the length; with
``grow`` the doubling goes on (2, 4, 8 ... times ``size``) until no candidate survives, which
measures how long repeated passages are.  At the first level each whole window is represented by
the half-length window of least hash inside it, the same one wherever the window occurs, so about
a quarter of the positions travel.

Documents are dealt into slices by the hash of their id.  Within a slice each window hash is
reduced to its smallest and largest document before it is shuffled, so a passage in a third of all
documents costs two rows per slice; the answer comes back per slice.  Texts are shuffled once.

Rule: a word goes if a window that covers it also occurs in a document with a smaller id; windows
are judged on the input.  Windows are compared by 64-bit hashes of whole words.

Cases: null and blank texts have no words; shorter texts than a window lose nothing; a null id is
larger than all others; rows with the same id are one document to this rule (neither is smaller),
and each gives its own row; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import row_key
from cloakwork.llm.grams import NONE, Words, contains, strings

SLICE_ROWS = 512


def _extremes(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per hash its smallest and, if another, its largest key."""
    if not len(hashes):
        return hashes, keys
    order = np.lexsort((keys, hashes))
    h, k = hashes[order], keys[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    last = np.concatenate((new[1:], [True]))
    lo, hi = k[new], k[last]
    more = hi > lo
    return np.concatenate((h[new], h[new][more])), np.concatenate((lo, hi[more]))


def _anchors(w: Words, hashes: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Per whole window (by its first word) the least hash of the base windows inside it."""
    short, first = w.windows(hashes, base)
    inside = size - base
    n = len(first) - inside
    if n <= 0:
        return NONE, np.zeros(0, np.int64)
    least = short[:n].copy()
    for j in range(1, inside + 1):
        np.minimum(least, short[j:n + j], out=least)
    ok = first[inside:] - first[:n] == inside  # no text ends between
    return least[ok], first[:n][ok]


def _table(hashes: np.ndarray, keys: np.ndarray) -> pa.Table:
    return pa.table({"h": pa.array(hashes.view(np.int64)), "key": pa.array(keys)})


def _answers(right: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a level that repeat, and the smallest document of each."""
    mine = right.filter(pa.compute.equal(right["level"], level)) if right.num_rows else right
    h = mine["h"].to_numpy().astype(np.int64).view(np.uint64)
    h, at = np.unique(h, return_index=True)
    return h, mine["lo"].to_numpy()[at]


def _keys(left: pa.Table) -> np.ndarray:
    return left["key"].to_numpy().astype(np.int64)


def _first_level(size: int, base: int):
    def run(_, left: pa.Table) -> pa.Table:
        w, keys = Words(left["text"]), _keys(left)
        least, first = _anchors(w, w.hashes(), size, base)
        return _table(*_extremes(least, keys[w.of[first]]))

    return lambda left: run(None, left)


def _next_level(size: int, base: int, length: int):
    """Windows of ``length`` words whose parts repeated at the level before."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(NONE, np.zeros(0, np.int64))
        w, keys = Words(left["text"]), _keys(left)
        hashes = w.hashes()
        found, first = w.windows(hashes, length)
        if length == size:
            least, _ = _anchors(w, hashes, size, base)
            ok = contains(_answers(right, base)[0], least)
        else:
            half, at = w.windows(hashes, length // 2)
            good = np.zeros(len(hashes) + 1, bool)
            good[at[contains(_answers(right, length // 2)[0], half)]] = True
            ok = good[first] & good[first + length // 2]
        return _table(*_extremes(found[ok], keys[w.of[first[ok]]]))

    return run


def _removal(size: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        w, keys = Words(left["text"]), _keys(left)
        found, first = w.windows(w.hashes(), size)
        known, lo = _answers(right, size)
        gone = np.zeros(len(w.starts) + 1, np.int64)
        if len(known) and len(found):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = first[(known[at] == found) & (lo[at] < keys[w.of[first]])]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + size, -1)
        kept = np.cumsum(gone)[:-1] == 0
        buf = w.buf.copy()
        buf[w.ends] = 0x20
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[w.starts[kept]] += 1
        edge[w.ends[kept] + 1] -= 1  # a kept word and one space after it ...
        keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        of, ends = w.of[kept], w.ends[kept]
        keep[ends[np.append(of[1:] != of[:-1], True)[:len(of)]]] = False  # ... but for the last
        n_kept = np.bincount(of, minlength=w.n)
        return pa.table({"doc_id": left["doc_id"], "n_words": pa.array(w.counts.astype(np.int64)),
                         "n_removed": pa.array((w.counts - n_kept).astype(np.int64)),
                         "kept": strings(buf, keep, w.stops).cast(pa.string())})

    return run


def _repeated(rows: DataFrame, level: int, slice_of) -> DataFrame:
    """Windows in two documents or more: slice, level, h, lo for every slice that has them."""
    dealt = rows.repartition("h")
    both = dealt.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("h", "lo")
    return dealt.join(both.hint("shuffle_hash"), "h").select(slice_of.alias("slice"), F.lit(level).alias("level"), "h", "lo")


def remove_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    base = (size + 1) // 2
    slices, sliced = _sliced(docs, id_col, text_col, slice_rows)
    found = _repeated(sliced.groupBy("slice").applyInArrow(_first_level(size, base), "h long, key long"), base, slices)
    whole = sliced.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(_next_level(size, base, size), "h long, key long")
    answers = _repeated(whole, size, slices)
    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        _removal(size), "doc_id long, n_words long, n_removed long, kept string")


def _sliced(docs: DataFrame, id_col: str, text_col: str, slice_rows: int):
    n = max(1, -(-docs.count() // slice_rows))
    slices = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col).alias("key"), F.col(text_col).alias("text"))
    return slices, rows.withColumn("slice", slices).repartition("slice")


def repeat_levels(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """words, windows: how many different windows of size, 2 size, 4 size ... words repeat across documents, until none does."""
    from cloakwork.llm.common import written

    base = (size + 1) // 2
    slices, sliced = _sliced(docs, id_col, text_col, slice_rows)
    found = _repeated(sliced.groupBy("slice").applyInArrow(_first_level(size, base), "h long, key long"), base, slices)
    length, out = size, []
    while True:
        rows = sliced.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(_next_level(size, base, length), "h long, key long")
        found = written(_repeated(rows, length, slices), "repeats")
        n = found.select("h").distinct().count()
        if not n:
            return docs.sparkSession.createDataFrame(out, "words int, windows long")
        out.append((length, n))
        length *= 2
