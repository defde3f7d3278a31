"""Words of many texts at once as arrays: boundaries, 64-bit hashes, hashes of word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WHITE = [0x20, *range(0x09, 0x0E)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_STEP = np.uint64(0xD6E8FEB86659FD93)
NONE = np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTES[WHITE] = 0
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[WHITE] = True
#: For words of letters and digits only: every other ASCII character parts them.
_PARTS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class Words:
    """Words of a list of texts (null: empty), whole, in order; ``of`` is a word's text.  ``plain`` words end at punctuation."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, plain: bool = False) -> None:
        parts = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        self.n = len(parts)
        self.buf = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        self.stops = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        self.parting = _PARTS if plain else _IS_WHITE
        white = self.parting[self.buf]
        turn = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(white) and not white[0]:
            turn = np.concatenate(([0], turn))
        self.starts, self.ends = turn[::2], turn[1::2]
        self.of = np.searchsorted(self.stops, self.starts, "right")
        self.counts = np.bincount(self.of, minlength=self.n)

    def hashes(self, lower: bool = False, first: int | None = None) -> np.ndarray:
        """A hash per word; ``lower`` folds A-Z, ``first`` takes only so many bytes of each word."""
        if not len(self.starts):
            return NONE
        length = np.diff(np.append(self.starts, len(self.buf)))
        place = np.arange(self.starts[0], len(self.buf)) - np.repeat(self.starts, length)
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int((self.ends - self.starts).max()), _STEP))))
        if first is not None:
            powers[first:] = 0
        raw = self.buf[self.starts[0]:]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        table = np.where(self.parting, np.uint64(0), _BYTES)
        return mixed(np.add.reduceat(table[raw] * powers[np.minimum(place, len(powers) - 1)], self.starts - self.starts[0]))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words, and the index of their first words."""
        n = len(hashes) - size + 1
        if n <= 0:
            return NONE, np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out = out * _WORD_STEP + hashes[j:n + j]
        first = np.flatnonzero(self.of[:n] == self.of[size - 1:])
        return mixed(out[first]), first


def contains(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def strings(buf: np.ndarray, keep: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The kept bytes of each text as strings."""
    upto = np.concatenate(([0], np.cumsum(keep)))
    offsets = np.concatenate(([0], upto[stops])).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(buf[keep].tobytes())])
