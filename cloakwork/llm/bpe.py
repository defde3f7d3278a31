"""Byte-level BPE encoding and decoding.

Merges run on a hierarchical-bitmap rank queue: a bucket per merge rank holds positions of a linked
list of parts, the first set bit of a two-level bitmap names the lowest rank that has any, and
entries whose pair has changed meanwhile are skipped.  One queue serves all new pre-tokens of a
slice of rows; a pre-token of n bytes costs O(n log n), so one of megabytes is no problem.  Spark
spreads the rows; a task sees a slice of bounded size at a time and keeps a bounded cache of
pre-tokens.  The rank table (its size is that of the vocabulary) is broadcast.

Cases: a null text counts as empty and has no tokens; repeated rows are encoded alike; an empty
table gives an empty result; only the named columns are read, and result columns are new names.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
CACHE_ENTRIES = 250_000
CACHE_CHARS = 32


def slices(batches):
    """Batches in slices of bounded rows and bytes (one row at least), so that long texts don't add up."""
    for batch in batches:
        step = int(max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Merger:
    """Merges many pre-tokens at once on one rank queue.

    All bytes lie in one linked list with a stop after each pre-token.  ``buckets[r]`` holds the
    positions whose pair has rank r, ``words`` a bit per rank, ``upper`` a bit per word.  The lowest
    rank of all is the lowest of each pre-token that has it, so its bucket is merged as a whole; only
    where a merged part could form a pair of lower rank does each pre-token merge its leftmost first.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        most = max(ranks.values(), default=0)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.lower = np.zeros(most + 1, bool)  # ranks that may give rise to a pair of lower rank
        for part in (self.keys >> 20, self.keys & (1 << 20) - 1):
            self.lower[part[self.found < part]] = True
        self.words, self.upper, self.buckets = [0] * ((most >> 6) + 1), 0, {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.found[at], -1) if len(self.keys) else np.full(len(key), -1)

    def _push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.buckets[rank] = [part]
                self.words[rank >> 6] |= 1 << (rank & 63)
                self.upper |= 1 << (rank >> 6)
            else:
                bucket.append(part)

    def _pop(self) -> tuple[int, np.ndarray]:
        at = (self.upper & -self.upper).bit_length() - 1
        word = self.words[at]
        rank = (at << 6) + (word & -word).bit_length() - 1
        self.words[at] = word = word & (word - 1)
        if not word:
            self.upper &= self.upper - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)

    def _gives_lower(self, rank, here, ids, after, before, stop) -> np.ndarray:
        """Which merges would make a pair of lower rank with a neighbour, merged or not."""
        end, left = np.minimum(after[after[here]], len(ids) - 1), np.maximum(before[here], 0)
        twins = self._ranks_of(np.array([rank]), np.array([rank]))[0]
        out = np.full(len(here), 0 <= twins < rank)
        for ranks, there in ((self._ranks_of(np.full(len(here), rank), ids[end]), ~stop[end]), (self._ranks_of(ids[left], np.full(len(here), rank)), ~stop[left])):
            out |= there & (ranks >= 0) & (ranks < rank)
        return out

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each pre-token, four bytes an id."""
        raw = np.frombuffer(b"".join([p + b"\0" for p in pieces]), np.uint8)
        n = len(raw)
        if not n:
            return []
        stops = np.cumsum([len(p) + 1 for p in pieces]) - 1
        ids = self.bytes[raw]
        ids[stops] = -1
        after, before, current = np.arange(1, n + 1), np.arange(-1, n - 1), np.full(n + 1, -1)
        stop = np.zeros(n + 1, bool)
        stop[stops] = stop[n] = True
        piece_of = None
        start = np.flatnonzero(~stop[:-1] & ~stop[1:])
        rank = self._ranks_of(ids[start], ids[start + 1])
        start, rank = start[rank >= 0], rank[rank >= 0]
        current[start] = rank
        if len(start):
            self._push(rank, start)
        while self.upper:
            rank, here = self._pop()
            here = here[current[here] == rank]  # the others are stale: their pair has changed since
            if len(here) > 1:
                every = here = np.unique(here)
                chained = np.concatenate(([False], here[1:] == after[here[:-1]]))
                if chained.any():  # overlapping pairs, as in aaaa: every other one, from the left
                    index = np.arange(len(here))
                    run = index - np.maximum.accumulate(np.where(chained, 0, index))
                    here = here[run % 2 == 0]
                if self.lower[rank] and (sooner := self._gives_lower(rank, here, ids, after, before, stop)).any():
                    # a pre-token merges up to the part that gives a lower pair; the others wait
                    piece_of = np.cumsum(stop) if piece_of is None else piece_of
                    of, held = piece_of[here], here[sooner]
                    first = np.full(of[-1] + 1, n)
                    np.minimum.at(first, piece_of[held], held)
                    late = every[every > first[piece_of[every]]]
                    here = here[here <= first[of]]
                    if len(late):
                        self._push(np.full(len(late), rank), late)
            if not len(here):
                continue
            gone = after[here]
            end = after[gone]
            ids[here], after[here], before[end[end < n]], current[gone], current[here] = rank, end, here[end < n], -1, -1
            left = before[here]
            renewed = np.concatenate((here[~stop[end]], left[(left >= 0) & ~stop[left]]))
            if not len(renewed):
                continue
            ranks = self._ranks_of(ids[renewed], ids[after[renewed]])
            current[renewed] = ranks
            good = ranks >= 0
            if good.any():
                self._push(ranks[good], renewed[good])
        alive = np.zeros(n, bool)
        i = np.flatnonzero(np.concatenate(([True], stop[:n - 1])))
        alive[i] = True
        while len(i := i[~stop[i]]):
            i = after[i]
            alive[i] = True
        kept, out, at = ids[alive].astype("<i4").tobytes(), [], 0
        for size in (4 * np.add.reduceat(alive, np.concatenate(([0], stops[:-1] + 1), dtype=np.int64), dtype=np.int64)).tolist():
            out.append(kept[at:at + size - 4])
            at += size
        return out


class Encoder:
    """Splits texts and merges pre-tokens; remembers short ones in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.find, self.merge, self.ranks = regex.compile(pattern).findall, Merger(ranks), ranks
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = list(map(self.find, texts))
        young, old, long = self.young, self.old, {}
        new = []
        for piece in set(chain.from_iterable(split)):
            if piece not in young:
                ids = old.get(piece)
                if ids is None:
                    raw = piece.encode()
                    whole = self.ranks.get(raw)
                    if whole is None:
                        new.append((piece, raw))
                        continue
                    ids = whole.to_bytes(4, "little")
                young[piece] = ids
        for (piece, _), ids in zip(new, self.merge([raw for _, raw in new]), strict=True):
            (young if len(piece) <= CACHE_CHARS else long)[piece] = ids
        known = {**young, **long} if long else young
        out = [np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<i4") for pieces in split]
        if len(young) >= CACHE_ENTRIES:
            self.old, self.young = young, {}
        return out


def _encoding(table, pattern: str):
    def run(batches):
        # a broadcast value lives as long as its Python worker, and so does what the encoder remembers
        encoder = table.value.get("encoder") or table.value.setdefault("encoder", Encoder(table.value["ranks"], pattern))
        for batch in slices(batches):
            ids = encoder([x or "" for x in batch.column(1).to_pylist()])
            size = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), lists], ["doc_id", "n_tokens", "token_ids"])

    return run


def _decoding(table, names: list[str], ids_col: str):
    def run(batches):
        tokens = table.value.get("tokens") or table.value.setdefault("tokens", {i: b for b, i in table.value["ranks"].items()})
        token = tokens.__getitem__
        for batch in slices(batches):
            lists = batch.column(names.index(ids_col))
            raw = [None if x is None else b"".join(map(token, x.values.to_numpy().tolist())) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names)

    return run


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])


def _decoded(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("decoded", T.BinaryType())])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids (array<int>) of every whole text; no special tokens."""
    table = docs.sparkSession.sparkContext.broadcast({"ranks": ranks})
    return _rows(docs, id_col, text_col).mapInArrow(_encoding(table, pattern), ENCODED)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids.  Other columns stay."""
    table = encoded.sparkSession.sparkContext.broadcast({"ranks": ranks})
    schema = _decoded(encoded.schema)
    return encoded.mapInArrow(_decoding(table, schema.names, ids_col), schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded: both directions in one task."""
    table = docs.sparkSession.sparkContext.broadcast({"ranks": ranks})
    there, schema = _encoding(table, pattern), _decoded(ENCODED)
    back = _decoding(table, schema.names, "token_ids")
    return _rows(docs, id_col, text_col).mapInArrow(lambda batches: back(there(batches)), schema)


def encode_whole(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of ids and of the bytes decoded from them."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return round_trip(docs, ranks, pattern, id_col, text_col).select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
