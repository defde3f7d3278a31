"""Language-model scoring with a probabilistic suffix tree over words.

A text is its words, A-Z lower-cased, and one end symbol.  Every symbol has a count over all
training texts (the tree's root, of the size of the vocabulary).  Below the root stand contexts of
one to ``DEPTH`` words: a context s with next symbol x enters the tree if the pair occurs ``LEAST``
times, and s is retained if a divergence test (G-test of its next symbols against those after the
context without its oldest word) is significant, or a longer retained context ends in it.  A retained
context's next-symbol probabilities are smoothed with those of its parent (Witten-Bell); a text is
scored with the longest retained suffix at each place.

The tree grows with the corpus and is never collected.  Texts are tokenized once, into slices of
bounded size.  Level by level each slice sends every distinct (context, symbol) pair once, as sorted
arrays of hashes and counts, one for each range of hashes, and gets the counts over all slices back in
the same order, so no hash comes back and no row holds a single pair.  A pair can only be frequent if it
is so without the oldest and without the newest word, so a slice sends no others.  A context of ``d``
words is a pair of the level ``d - 1`` at the place before.  What a pair is tested against (its context, its
parent's pair and context) occurs at the same place, so one slice that has the pair knows all four
counts; from the longest contexts on each slice sends its part of their tests, and gets the retained ones back.

Score of a text: sum over symbols of log10 P(symbol | longest retained suffix); base score: add-one
unigrams.  With U = (c + 1) / (N + V + 1) as root, probabilities of all symbols, an unknown one
included, sum to one after every context.

Cases: null and empty texts are one end symbol; a null id is the empty string to the folds; repeated
rows are all counted and scored alike; nothing to learn from gives N = V = 0; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import written
from cloakwork.llm.grams import Words, mixed

DEPTH, LEAST, G_LEAST = 3, 2, 30.0
SLICE_ROWS, SLICE_BYTES, BUCKET_SYMBOLS = 4096, 6 << 20, 1 << 20
END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def symbols(texts) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol hashes of all texts with their end symbols, the text of each, and the number of texts."""
    w = Words(texts)
    at = np.arange(len(w.starts)) + w.of
    out, of = np.full(len(w.starts) + w.n, END), np.zeros(len(w.starts) + w.n, np.int64)
    out[at] = w.hashes(lower=True)
    of[at] = w.of
    ends = np.cumsum(w.counts + 1) - 1
    of[ends] = np.arange(w.n)
    return out, of, w.n


def packed(x: np.ndarray, dense: bool = False) -> bytes:
    """Values of 8 bytes, byte by byte without leading bytes that are zero in all; behind their number and that of the bytes kept.  ``dense`` values would not compress."""
    raw = x.view(np.uint64)
    planes = max(1, -(-int(raw.max() if len(raw) else 0).bit_length() // 8))
    kept = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return len(raw).to_bytes(8, "little") + bytes([planes, dense]) + (kept if dense or not kept else pa.compress(kept, "zstd", asbytes=True))


def unpacked(b: bytes, kind: type = np.int64) -> np.ndarray:
    n, planes, dense = int.from_bytes(b[:8], "little"), b[8], b[9]
    kept = b[10:] if dense or not n else pa.decompress(b[10:], n * planes, "zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(kept, np.uint8).reshape(planes, n).T
    return out.reshape(-1).view(kind)


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in ascending order, and the keys in that order.

    Values are sorted faster than places, so the low bits of hashes give way to the place; where that mixes up
    hashes that agree in all other bits, places are sorted after all.
    """
    bits = np.uint64(max(1, len(keys).bit_length()))
    order = (np.sort(keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys)
        ordered = keys[order]
    return order, ordered


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, an index of each, and the number of each key among them."""
    order, ordered = _order(keys)
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


class _Table:
    """Values by sorted 64-bit key; zero where a key is missing."""

    def __init__(self, known: np.ndarray, *values: np.ndarray) -> None:
        self.known, self.values = known, values

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.known):
            return [np.zeros(len(keys), x.dtype) for x in self.values]
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        hit = self.known[at] == keys
        return [np.where(hit, x[at], 0) for x in self.values]


def _before(x: np.ndarray) -> np.ndarray:
    """Values of the place before; zero at the first."""
    return np.concatenate((np.zeros(1, x.dtype), x[:-1]))


def _smoothed(p: np.ndarray, i: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray, held: np.ndarray) -> None:
    """A context gives n / (total + kinds) to the symbols stored under it and the rest, which its other
    symbols and kinds had, to all symbols by the parent's distribution: that sums to one."""
    whole = (total + kinds).astype(float)
    p[i] = (n + (whole - held) * p[i]) / whole


# ----------------------------------------------------------------------------- one slice
_SLICE = "slice long, doc_id array<long>, train array<boolean>, n array<long>, words binary, at binary"


def _sliced(rows: int):
    """Slices of a partition's rows: at most ``rows`` and about ``SLICE_BYTES`` of text each, one text at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_ = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                upto = np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES, "right")
                stop = max(start + 1, min(start + rows, int(upto)))
                part = batch.slice(start, stop - start)
                h, of, n = symbols(part["text"])
                words, _, at = _unique(h)
                values = [slice_, part["doc_id"].to_pylist(), part["train"].to_pylist(), np.bincount(of, minlength=n), packed(words, dense=True), packed(at)]
                yield pa.RecordBatch.from_pydict({f.split()[0]: pa.array([x], t) for f, t, x in zip(_SLICE.split(", "), _SLICE_TYPES, values, strict=True)})
                slice_, start = slice_ + 1, stop

    return run


_SLICE_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


class _Slice:
    """A slice's places and, for each level told, its distinct pairs: ``keys`` in order, a place of each (``first``),
    the number of the pair at a place (``at``; -1: none that can be in the tree) and, with one more zero for -1, their counts."""

    def __init__(self, left: pa.Table, right: pa.Table, depth: int, least: float) -> None:
        self.doc_id, self.train, self.n = (left[c].combine_chunks().flatten() for c in ("doc_id", "train", "n"))
        self.of = np.repeat(np.arange(len(self.n)), self.n.to_numpy())
        self.right = right
        words, at = unpacked(left["words"][0].as_py(), np.uint64), unpacked(left["at"][0].as_py())
        first = np.empty(len(words), np.int64)
        first[at] = np.arange(len(at))
        self.keys, self.at, self.first, self.counts, self.once = [words], [at], [first], [], []
        self.inner = np.concatenate((np.zeros(min(1, len(at)), bool), self.of[1:] == self.of[:-1]))
        h = pair = words[at]
        for d in range(depth + 1):
            if d:
                above = self.counts[d - 1][self.at[d - 1]] > 0
                places = np.flatnonzero(self.inner & above & _before(above))
                pair = mixed(_before(pair) * _STEP + h)
                keys, first, number = _unique(pair[places])
                at = np.full(len(h), -1)
                at[places] = number
                self.keys.append(keys)
                self.at.append(at)
                self.first.append(places[first])
            told = self._told(d, 0, 2)
            if told or not len(self.keys[d]):  # of no pair nothing is told
                told = told or [np.zeros(0, np.int64)] * 2
                counts, once = told
                if d == 0:
                    self.root = counts
                    counts = np.where(counts >= least, counts, 0)
                self.counts.append(np.append(counts, 0))
                self.once.append(once > 0)

    def _told(self, level: int, depth: int, values: int) -> list[np.ndarray]:
        """What was told of the pairs of a level (depth 0), or of those that are contexts of ``depth`` words."""
        rows = self.right.filter(pa.compute.and_(pa.compute.equal(self.right["level"], level), pa.compute.equal(self.right["depth"], depth))).sort_by("bucket")
        told = rows["values"].to_pylist()
        return [np.concatenate([unpacked(x[j]) for x in told]) for j in range(values)] if told else []

    def asked(self, depth: int) -> np.ndarray:
        """The pairs that can be contexts of ``depth`` words."""
        return np.flatnonzero(self.counts[depth - 1][:-1] > 0)

    def retained(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Kinds and held of each context of ``depth`` words, by the number of its pair; zero if it is not retained."""
        kinds, held = np.zeros((2, len(self.keys[depth - 1]) + 1), np.int64)
        told = self._told(depth - 1, depth, 2)
        if told:
            at = self.asked(depth)
            kinds[at], held[at] = told
        return kinds, held

    def pairs(self, depth: int) -> list[np.ndarray]:
        """Every distinct pair, with its count in the slice's training texts."""
        at, train = self.at[depth], self.train.to_numpy(zero_copy_only=False)[self.of]
        return [self.keys[depth], np.bincount(at[(at >= 0) & train], minlength=len(self.keys[depth]))]

    def contexts(self, depth: int, total: int, last: int) -> list[np.ndarray]:
        """Every distinct context with its part of the test: kinds, held, gain of the pairs this slice has to report, and whether a longer retained one ends in it."""
        above, below = self.counts[depth - 1], self.counts[depth]
        pair = np.flatnonzero((below[:-1] > 0) & self.once[depth])
        i = self.first[depth][pair]
        context = self.at[depth - 1][i - 1]
        n, whole = below[pair].astype(float), above[context]
        parent = total if depth == 1 else self.counts[depth - 2][self.at[depth - 2][i - 1]]
        gain = 2 * n * np.log(n / whole / (above[self.at[depth - 1][i]] / parent))
        size = len(self.keys[depth - 1])
        sums = [np.bincount(context, x, size) for x in (None, n, gain)]
        needed = np.zeros(size, np.int64)
        if depth < last:
            longer = np.flatnonzero(self.retained(depth + 1)[0])
            needed[self.at[depth - 1][self.first[depth][longer]]] = 1
        return [x[self.asked(depth)] for x in (self.keys[depth - 1], sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2].astype(float), needed)]

    def probabilities(self, root: np.ndarray, depth: int) -> np.ndarray:
        """P of each symbol, given its root probability."""
        p, i = root.copy(), np.flatnonzero(self.inner)
        for d in range(1, depth + 1):
            kinds, held = self.retained(d)
            context = self.at[d - 1][i - 1]
            alive = kinds[context] > 0
            i, context = i[alive], context[alive]
            _smoothed(p, i, self.counts[d][self.at[d][i]], self.counts[d - 1][context], kinds[context], held[context])
        return p


# ----------------------------------------------------------------------------- between slices
_SENT = "slice long, bucket int, keys binary, values array<binary>"
_TOLD = "slice long, level int, depth int, bucket int, values array<binary>, total long, kinds long"


def _base(bucket: int, buckets: int) -> np.uint64:
    return np.uint64(((bucket << 32) // buckets) << 32)


def _messages(slice_: int, columns: list[np.ndarray], buckets: int) -> pa.Table:
    """Sorted keys and their values, a row for each range of keys."""
    keys, *values = columns
    range_ = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(range_, np.arange(buckets + 1))
    some = np.flatnonzero(ends[1:] > ends[:-1])
    cut = [slice(ends[b], ends[b + 1]) for b in some]
    steps = [packed(np.diff(keys[c], prepend=_base(int(b), buckets)), dense=True) for b, c in zip(some, cut, strict=True)]
    return pa.table({"slice": pa.array([slice_] * len(some), pa.int64()), "bucket": pa.array(some, pa.int32()), "keys": pa.array(steps, pa.binary()),
                     "values": pa.array([[packed(x[c]) for x in values] for c in cut], pa.list_(pa.binary()))})


def _asking(depth: int, least: float, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _messages(left["slice"][0].as_py(), _Slice(left, right, depth, least).pairs(depth), buckets)

    return run


def _testing(depth: int, total: int, last: int, least: float, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _messages(left["slice"][0].as_py(), _Slice(left, right, depth, least).contexts(depth, total, last), buckets)

    return run


def _received(sent: pa.Table, buckets: int, kinds: list[type]) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Of one range of keys: the slices, their keys and values one behind the other, and where those of each slice end."""
    sent = sent.sort_by("slice")
    base = _base(sent["bucket"][0].as_py(), buckets)
    keys = [base + np.cumsum(unpacked(x, np.uint64)) for x in sent["keys"].to_pylist()]
    values = sent["values"].to_pylist()
    columns = [np.concatenate(keys), *[np.concatenate([unpacked(x[j], kind) for x in values]) for j, kind in enumerate(kinds)]]
    return sent["slice"].to_pylist(), columns, np.cumsum([len(k) for k in keys])


def _replies(sent: pa.Table, slices: list[int], ends: np.ndarray, level: int, depth: int, values: list[np.ndarray], once: np.ndarray | None = None) -> pa.Table:
    parts = [np.split(x, ends[:-1]) for x in values]
    same = lambda x, t: pa.array([x] * len(slices), t)
    sums = [pa.array([int(c[o > 0].sum()) for c, o in zip(*parts, strict=True)], pa.int64()), pa.array([int(o.sum()) for o in parts[1]], pa.int64())]
    return pa.table({"slice": pa.array(slices, pa.int64()), "level": same(level, pa.int32()), "depth": same(depth, pa.int32()),
                     "bucket": same(sent["bucket"][0].as_py(), pa.int32()), "values": pa.array([[packed(x) for x in row] for row in zip(*parts, strict=True)], pa.list_(pa.binary())),
                     "total": sums[0], "kinds": sums[1]})


def _counting(level: int, least: float, buckets: int):
    """Counts of pairs over all slices (zero below ``least``), and which one slice is to report each; total and kinds are those of the pairs to report."""
    def run(sent: pa.Table) -> pa.Table:
        slices, (keys, n), ends = _received(sent, buckets, [np.int64])
        distinct, _, number = _unique(keys)
        c = np.bincount(number, n, len(distinct)).astype(np.int64)
        has = np.flatnonzero(n > 0)
        one = np.full(len(distinct), -1)
        one[number[has[::-1]]] = has[::-1]
        once = np.zeros(len(keys), np.int64)
        once[one[one >= 0]] = 1
        return _replies(sent, slices, ends, level, 0, [np.where(c >= least, c, 0)[number], once])

    return run


def _judging(depth: int, g_least: float, buckets: int):
    """Kinds and held of the retained contexts."""
    def run(sent: pa.Table) -> pa.Table:
        slices, (keys, *parts), ends = _received(sent, buckets, [np.int64, np.int64, np.float64, np.int64])
        distinct, _, number = _unique(keys)
        kinds, held, gain, needed = (np.bincount(number, x, len(distinct)) for x in parts)
        kept = (kinds > 0) & ((np.abs(gain) >= g_least) | (needed > 0))
        return _replies(sent, slices, ends, depth - 1, depth, [np.where(kept, x, 0).astype(np.int64)[number] for x in (kinds, held)])

    return run


class _Growth:
    """Slices, and what they were told so far: a table per round, as large as its counts."""

    def __init__(self, texts: DataFrame, least: float, g_least: float, slice_rows: int) -> None:
        self.least, self.g_least = least, g_least
        self.slices = written(texts.mapInArrow(_sliced(slice_rows), _SLICE), "slices", drop_shuffles=True)
        size = self.slices.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
        self.buckets = max(1, size // BUCKET_SYMBOLS)
        self.told: dict[tuple[int, int], DataFrame] = {}

    def all_told(self, of: list[tuple[int, int]]) -> DataFrame:
        return reduce(DataFrame.union, [self.told[x] for x in of]) if of else self.slices.sparkSession.createDataFrame([], _TOLD)

    def with_told(self, of: list[tuple[int, int]], f, schema: str) -> DataFrame:
        """Each slice with what it was told of those levels and depths."""
        return self.slices.groupBy("slice").cogroup(self.all_told(of).groupBy("slice")).applyInArrow(f, schema)

    def round(self, key: tuple[int, int], of: list[tuple[int, int]], ask, answer) -> DataFrame:
        sent = self.with_told(of, ask, _SENT)
        self.told[key] = written(sent.groupBy("bucket").applyInArrow(answer, _TOLD), "told", drop_shuffles=True)
        return self.told[key]

    def count(self, level: int) -> DataFrame:
        return self.round((level, 0), [(d, 0) for d in range(level)], _asking(level, self.least, self.buckets), _counting(level, self.least if level else 0, self.buckets))

    def grow(self, total: int, depth: int) -> None:
        for d in range(1, depth + 1):
            self.count(d)
        for d in range(depth, 0, -1):
            longer = [(d, d + 1)] if d < depth else []
            self.round((d - 1, d), [*[(x, 0) for x in range(d + 1)], *longer], _testing(d, total, depth, self.least, self.buckets), _judging(d, self.g_least, self.buckets))


class Tree:
    """The retained tree of one slice, for lookup of any places."""

    def __init__(self, grown: tuple[pa.Table, pa.Table, int, float]) -> None:
        left, right, depth, least = grown
        s = _Slice(left, right, depth, least)
        self.levels = [(_Table(s.keys[d], s.counts[d][:-1]), _Table(s.keys[d - 1], s.counts[d - 1][:-1], *[x[:-1] for x in s.retained(d)])) for d in range(1, depth + 1)]

    def probabilities(self, h: np.ndarray, of: np.ndarray, root: np.ndarray) -> np.ndarray:
        """P of each symbol, given its root probability."""
        p, pair = root.copy(), h
        i = 1 + np.flatnonzero(of[1:] == of[:-1])
        for d, (pairs, kept) in enumerate(self.levels, 1):
            i = i[(i >= d) & (of[i - d] == of[i])]
            total, kinds, held = kept(pair[i - 1])
            pair = mixed(_before(pair) * _STEP + h)
            alive = kinds > 0
            i = i[alive]
            _smoothed(p, i, pairs(pair[i])[0], total[alive], kinds[alive], held[alive])
        return p


def grow(texts: DataFrame, total: int, root: dict[int, int], depth: int = DEPTH, least: float = LEAST, g_least: float = G_LEAST) -> tuple[pa.Table, pa.Table, int, float]:
    """The retained tree of a few texts, which are one slice, for :class:`Tree`; ``root`` has the counts of their symbols."""
    none = F.lit(None).cast("long").alias("doc_id")
    g = _Growth(texts.select(none, F.lit(True).alias("train"), "text").coalesce(1), least, g_least, SLICE_ROWS)
    left = g.slices.toArrow()
    if left.num_rows != 1:
        raise ValueError("the texts must fit one slice")
    counts = np.array([root.get(x, 0) for x in unpacked(left["words"][0].as_py()).tolist()], np.int64)
    row = (left["slice"][0].as_py(), 0, 0, 0, [packed(counts), packed(np.ones(len(counts), np.int64))], 0, 0)
    g.told[0, 0] = texts.sparkSession.createDataFrame([row], _TOLD)
    g.grow(total, depth)
    return left, g.all_told(list(g.told)).toArrow(), depth, least


def _scores(total: int, kinds: int, depth: int, least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = _Slice(left, right, depth, least)
        count = s.root[s.at[0]]
        root = (count + 1) / (total + kinds + 1)
        p = s.probabilities(root, depth)
        add = lambda x: np.bincount(s.of, x, len(s.n))
        whole = lambda x: pa.array(add(x).astype(np.int64))
        return pa.table({"doc_id": s.doc_id, "train": s.train, "n_tokens": whole(None), "n_known": whole(count > 0),
                         "base_score": pa.array(add(np.log10(root))), "score": pa.array(add(np.log10(p)))})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2,
          depth: int = DEPTH, least: float = LEAST, g_least: float = G_LEAST, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    part = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), (part != held_out).alias("train"), F.col(text_col).alias("text"))
    g = _Growth(texts, least, g_least, slice_rows)
    size = g.count(0).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    g.grow(size["n"], depth)
    out = g.with_told(list(g.told), _scores(size["n"], size["v"], depth, least), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(size["n"]).cast("long").alias("train_tokens"), "base_score", "score")
