"""Near-duplicate documents by n-gram Jaccard similarity: MinHash banding, then exact verification.

1. Each text becomes the set of its word n-grams (a text with fewer words: one gram of all words)
   and a MinHash signature.  Texts with equal sets are one node, named by a hash of the set; only
   the text of its first row (by id, then hash of the text) goes on.
2. Each of ``TREES`` bands labels a signature with ``DEPTH`` hash values of its own.  The prefix of a
   label that counts has one fixed length, the longest at which the recall expected at the threshold
   reaches the target; signatures that share a prefix in some band are candidates.
   An estimate from the whole signature, with a margin of five standard errors, drops
   chance meetings.
3. Candidates that hang together are verified exactly on their gram sets.

Work inside a prefix or a group goes in blocks of bounded size (a pair of blocks is the largest
unit, whatever a group's size), and only a spanning forest and the link counts leave it, never the
pairs.

Links join documents of similarity ``threshold`` or more; copies (equal sets) count as links of each
other.  A class is a connected component of links, named by its smallest document id.

Cases: texts without a word have no grams and are alone; null ids count as the largest id; rows that
share an id, or have none, are documents of their own, with the classes of their texts, and count as
links; ties cannot change classes; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import LAST_ID, row_key, written
from cloakwork.llm.components import components
from cloakwork.llm.grams import Words

SIZE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.9995
BLOCK = 256
_ODD = np.random.default_rng(11).integers(1, 1 << 31, TREES * DEPTH, np.uint32) * 2 + 1
_XOR = np.random.default_rng(13).integers(0, 1 << 32, TREES * DEPTH, np.uint32)


def prefix_length(threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def gram_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of every text, sorted by text and hash, and the texts they belong to."""
    hashes = w.hashes()
    grams, first = w.windows(hashes, size)
    of = w.of[first]
    for n in range(1, size):  # shorter texts: all their words
        short = np.flatnonzero(w.counts == n)
        if len(short):
            g, f = w.windows(hashes, n)
            take = np.isin(w.of[f], short)
            grams, of = np.concatenate((grams, g[take])), np.concatenate((of, w.of[f][take]))
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1]))[:len(grams)]
    return grams[new], of[new]


def _signatures(size: int):
    schema = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("sig", pa.binary())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column("text"))
        grams, of = gram_sets(w, size)
        n = np.bincount(of, minlength=w.n)
        some = np.flatnonzero(n)
        starts = np.concatenate(([0], np.cumsum(n[some])[:-1])).astype(np.int64)
        sig = np.zeros((w.n, len(_ODD)), np.uint32)
        h, g = np.zeros(w.n, np.uint64), np.zeros(w.n, np.uint64)
        if len(some):
            low = (grams >> np.uint64(32)).astype(np.uint32)
            for i, (a, x) in enumerate(zip(_ODD, _XOR, strict=True)):
                sig[some, i] = np.minimum.reduceat((low ^ x) * a, starts)
            h[some], g[some] = np.add.reduceat(grams, starts), np.bitwise_xor.reduceat(grams * np.uint64(0x9FB21C651E98DF25), starts)
        return pa.record_batch([batch.column("key"), batch.column("t"), pa.array(n), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)),
                                pa.array([x.tobytes() for x in sig], pa.binary())], schema=schema)

    def run(batches):
        for whole in batches:
            step = int(max(1, whole.num_rows * (2 << 20) // max(1, whole.nbytes)))
            for start in range(0, whole.num_rows, step):
                yield one(whole.slice(start, step))

    return run


def _by_group(batches, names: list[str]):
    """Whole groups (equal values in the named columns) from batches sorted by them, as tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        new = np.zeros(batch.num_rows, bool)
        for x in ids:
            new[1:] |= x[1:] != x[:-1]
        if held and any(held[-1].column(n)[-1] != batch.column(n)[0] for n in names):
            new[0] = True
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component in a small graph."""
    label = np.arange(n)
    while len(rows):
        least = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, least)
        np.minimum.at(new, cols, least)
        np.minimum.at(new, label[rows], least)
        np.minimum.at(new, label[cols], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _candidates(least: float):
    """Edges of a spanning forest over signatures of estimated similarity ``least`` or more, per block pair."""
    def run(batches):
        a, b = [], []
        for group in _by_group(batches, ["bucket", "i", "j"]):
            rep, side = group["rep"].to_numpy(), group["side"].to_numpy()
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(len(rep), -1)
            rows, cols = [], []
            for x in range(len(rep) - 1):
                alike = (sig[x + 1:] == sig[x]).mean(axis=1) >= least
                if group["i"][0] != group["j"][0]:
                    alike &= side[x + 1:] != side[x]
                hit = np.flatnonzero(alike) + x + 1
                rows.append(np.full(len(hit), x))
                cols.append(hit)
            if rows:
                label = _forest(len(rep), np.concatenate(rows), np.concatenate(cols))
                other = np.flatnonzero(label != np.arange(len(rep)))
                a.append(rep[other])
                b.append(rep[label[other]])
            if sum(map(len, a)) > 50_000:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _common(grams: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all pairwise intersections, over the grams that two sets or more hold."""
    values, at, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    take = shared[at]
    column, row = place[at[take]], of[take]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = 4096
    for low in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, (low, low + width))
        part = np.zeros((n, width), np.float32)
        part[row[s:e], column[s:e] - low] = 1
        out += part @ part.T
    return out


def _links(size: int, threshold: float):
    """Per block pair: each document's links (copies of the other side counted) and a spanning forest of the links."""
    def run(batches):
        for group in _by_group(batches, ["cluster", "i", "j"]):
            rep, side, copies = (group[c].to_numpy() for c in ("rep", "side", "copies"))
            grams, of = gram_sets(Words(group["text"].combine_chunks()), size)
            n = np.bincount(of, minlength=len(rep))
            both = _common(grams, of, len(rep))
            union = n[:, None] + n[None, :] - both
            link = both >= threshold * union - 1e-6
            np.fill_diagonal(link, False)
            if group["i"][0] != group["j"][0]:
                link &= side[:, None] != side[None, :]
            label = _forest(len(rep), *np.nonzero(link))
            yield pa.record_batch([pa.array(rep), pa.array(rep[label]), pa.array(link @ copies)], ["a", "b", "links"])

    return run


def _block_pairs(rows: DataFrame, group: str, size_col: str, block: int) -> DataFrame:
    """Each row once per pair of blocks that its own block is in: columns i <= j, side."""
    blocks = F.ceil(F.col(size_col) / block).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    return rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("p", F.explode(pairs)).select(
        "*", "p.i", "p.j", F.col("own").alias("side")).drop("blocks", "own", "p")


def _classes(docs: DataFrame, size: int, threshold: float, recall: float, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with key, t (hash of the text), h, g, n (their gram set), and gram sets with first (their first row), label (of the class) and links."""
    base = docs.select(row_key(id_col).alias("key"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    signed = written(base.mapInArrow(_signatures(size), "key long, t long, n long, h long, g long, sig binary"), "signatures")
    sets = written(signed.filter("n > 0").groupBy("h", "g", "n").agg(F.min(F.struct("key", "t")).alias("first"), F.count("*").alias("copies")).select(
        F.xxhash64("h", "g", "n").alias("rep"), "*"), "sets")
    reps = signed.join(sets.select("rep", "copies", "first.*", "h", "g", "n"), ["key", "t", "h", "g", "n"]).select(
        "rep", "copies", "sig").dropDuplicates(["rep"])

    depth = prefix_length(threshold, recall)
    prefixes = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 1 + 4 * DEPTH * t, 4 * depth)) for t in range(TREES)])
    labels = written(reps.select("rep", F.explode(prefixes).alias("bucket")), "labels")
    crowded = labels.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    met = labels.join(crowded, "bucket").join(reps.select("rep", "sig"), "rep")
    estimate = max(0.0, threshold - 5 * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH)))
    sorted_tries = _block_pairs(met, "bucket", "m", block).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "sig")
    edges = sorted_tries.select("bucket", "i", "j", "side", "rep", "sig").mapInArrow(_candidates(estimate), "a long, b long")
    clusters = written(components(edges).select(F.col("node").alias("rep"), F.col("label").alias("cluster")), "clusters")

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    texts = clusters.join(sizes, "cluster").join(sets.select("rep", "copies", "first.*"), "rep").join(
        base.dropDuplicates(["key", "t"]), ["key", "t"])
    blocks = _block_pairs(texts, "cluster", "m", block).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    linked = written(blocks.select("cluster", "i", "j", "side", "rep", "copies", "text").mapInArrow(
        _links(size, threshold), "a long, b long, links long"), "links")
    classes = components(linked.select("a", "b")).select(F.col("node").alias("rep"), "label")
    links = linked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    known = sets.join(classes, "rep", "left").join(links, "rep", "left").select(
        "h", "g", "n", "first", F.coalesce("label", "rep").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return signed.select("key", "t", "h", "g", "n"), known


def near_duplicates(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL,
                    id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_links (other documents at the threshold or above)."""
    rows, known = _classes(docs, size, threshold, recall, id_col, text_col, block)
    known = written(known, "classes")
    ids = known.groupBy("label").agg(F.min("first.key").alias("class"))
    named = rows.join(known.join(ids, "label").select("h", "g", "n", "class", "links"), ["h", "g", "n"], "left")
    real = lambda c: F.when(c != LAST_ID, c)
    return named.select(real(F.col("key")).alias("doc_id"), real(F.coalesce("class", "key")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL,
                id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents, with their columns, of which one of each class stays: the first by id, then hash of the text.

    Of rows that share id and text one stays; so of texts without a word, which are alone.
    """
    rows, known = _classes(docs, size, threshold, recall, id_col, text_col, block)
    first = known.groupBy("label").agg(F.min("first").alias("first")).select("first.*")
    stay = first.union(rows.filter("n = 0").select("key", "t").distinct()).select(F.col("key").alias("_key"), F.col("t").alias("_t"))
    kept = docs.withColumn("_own_key", row_key(id_col)).withColumn("_own_t", F.xxhash64(text_col)).join(
        stay, (F.col("_own_key") == F.col("_key")) & (F.col("_own_t") == F.col("_t")), "left_semi")
    return kept.dropDuplicates(["_own_key", text_col]).select(*docs.columns)
