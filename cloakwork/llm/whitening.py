"""Embedding whitening: leading eigenpairs of the covariance by spectrum slicing.

Vectors become integers (``floor(64 * c) + 1000000``), so sums, means and deviations are exact.  The
covariance is taken over the different integer vectors, centred before multiplying: one Spark pass
sums, one pass adds up centred products per task.  What reaches the driver has the size of one
covariance matrix, whatever the number of vectors.

Eigenvalues are found by counting: LDL' of the covariance minus a shift has as many negative pivots as
there are eigenvalues below the shift.  Counts halve the spectrum until every leading eigenvalue lies
alone in its slice (or in a slice too narrow to halve, with its count as multiplicity); Rayleigh quotient
iteration from the middle of the slice then converges cubically, and counts on both sides of the result certify
that it is the eigenvalue of its number.  Where the quotient leaves its slice, the slice is halved and the
iteration starts anew.

Cases: vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another
length than most have (ties: the shorter) or with an entry whose integer leaves the range of a long;
equal vectors count once in the fit and all get rows; repeated ids keep their rows; directions without variance have no component (fewer
than 16 come back); a deviation beyond a long is null; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BATCH_VECTORS = 4096
LONG = (1 << 63) - 1


# ----------------------------------------------------------------------------- the spectrum (driver, d x d)
def inertia(a: np.ndarray) -> int:
    """Number of negative eigenvalues: pivots of LDL', with diagonal pivots and 2 x 2 blocks where no diagonal is large enough."""
    a, below = a.copy(), 0
    alpha = (1 + 17 ** 0.5) / 8
    while len(a):
        d = np.abs(np.diagonal(a))
        off = np.abs(a - np.diag(np.diagonal(a)))
        k = int(d.argmax())
        i, j = divmod(int(off.argmax()), len(a))
        if d[k] == 0 and off[i, j] == 0:
            return below
        if d[k] >= alpha * off[i, j]:
            keep = np.arange(len(a)) != k
            column = a[keep, k]
            below += bool(a[k, k] < 0)
            a = a[np.ix_(keep, keep)] - np.outer(column, column / a[k, k])
        else:                                         # an indefinite block has one negative and one positive eigenvalue
            keep = np.ones(len(a), bool)
            keep[[i, j]] = False
            block, columns = a[np.ix_([i, j], [i, j])], a[np.ix_(keep, [i, j])]
            below += 1
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
            a = (a + a.T) / 2
    return below


class Slicer:
    """Leading eigenpairs of a symmetric matrix, largest first."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.a = (matrix + matrix.T) / 2
        self.size = len(self.a)
        self.norm = float(np.abs(self.a).sum(axis=1).max())          # no eigenvalue lies beyond it
        self.tiny = self.norm * self.size * np.finfo(float).eps
        self.counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        """How many eigenvalues lie above the shift."""
        if shift not in self.counts:
            self.counts[shift] = inertia(shift * np.eye(self.size) - self.a)
        return self.counts[shift]

    def slices(self, most: int, floor: float) -> Iterator[tuple[float, float, int]]:
        """(low, high, multiplicity), from the top, until ``most`` eigenvalues above ``floor`` are covered."""
        todo, covered = [(floor, self.norm + self.tiny)], 0
        while todo and covered < most:
            low, high = todo.pop()
            n = self.above(low) - self.above(high)
            if n == 0:
                continue
            if n == 1 or high - low <= 4 * self.tiny:
                yield low, high, n
                covered += n
                continue
            middle = (low + high) / 2
            todo += [(low, middle), (middle, high)]

    def pair(self, low: float, high: float, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """The eigenpair in a slice, by Rayleigh quotient iteration across the vectors found before."""
        basis = np.array(found).reshape(len(found), self.size)
        rnd = np.random.default_rng(len(found))
        across = lambda v: v - basis.T @ (basis @ v)
        while True:
            v = across(rnd.standard_normal(self.size))
            v /= np.linalg.norm(v)
            shift = (low + high) / 2
            for _ in range(40):
                try:
                    w = np.linalg.solve(self.a - shift * np.eye(self.size), v)
                except np.linalg.LinAlgError:          # the shift is an eigenvalue to the last bit
                    w = np.linalg.solve(self.a - (shift + self.tiny) * np.eye(self.size), v)
                w = across(across(w))
                v = w / np.linalg.norm(w)
                quotient = float(v @ self.a @ v)
                if np.linalg.norm(self.a @ v - quotient * v) <= self.tiny and low - self.tiny <= quotient <= high + self.tiny:
                    return quotient, v
                if not low <= quotient <= high:
                    break
                shift = quotient
            if high - low <= 4 * self.tiny:
                return quotient, v
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) > self.above(high) else (low, middle)

    def certified(self, number: int, value: float) -> bool:
        """Counts around a value say that it is the eigenvalue of this number (1: the largest)."""
        return self.above(value + 4 * self.tiny) < number <= self.above(value - 4 * self.tiny)

    def leading(self, most: int, floor: float) -> list[tuple[float, np.ndarray]]:
        out: list[tuple[float, np.ndarray]] = []
        for low, high, n in self.slices(most, floor):
            group = []
            for _ in range(min(n, most - len(out))):
                group.append(self.pair(low, high, [v for _, v in [*out, *group]]))
            out += sorted(group, key=lambda p: -p[0])
        for number, (value, _) in enumerate(out, 1):
            if not self.certified(number, value):
                raise ArithmeticError(f"eigenvalue {number} is not where its count says")
        return out


# ----------------------------------------------------------------------------- tasks
def _matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_VECTORS):
            part = batch.slice(i, BATCH_VECTORS)
            yield part, _matrix(part.column(column))


def _summing(batches):
    """Exact sums per dimension of one task: halves of 32 bits add up without overflow."""
    n, total = 0, None
    for _, x in _parts(batches, 0):
        part = [int(h) * (1 << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
        total = part if total is None else [a + b for a, b in zip(total, part)]
        n += len(x)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
                                          pa.array([n] * len(total), pa.int64())], ["dim", "s", "n"])


class Centre:
    """Count and exact sums of the fit list: the mean as an integer part and a remainder of n."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        self.whole = [s // n for s in sums]
        self.rest = [s % n for s in sums]
        self.at = np.array(self.whole, np.int64)
        self.fraction = np.array([r / n for r in self.rest])
        self.rests = np.array(self.rest, np.int64)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; only the last step rounds."""
        return _minus(x, self.at) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)^2, exact; null beyond a long."""
        far = int(np.abs(_minus(x, self.at)).max(initial=0)) + 1
        if (far * self.n) ** 2 * max(x.shape[1], 1) < LONG:
            y = (x - self.at) * self.n - self.rests
            return (y * y).sum(1).tolist()
        exact = [sum((self.n * (int(a) - m) - r) ** 2 for a, m, r in zip(row, self.whole, self.rest)) for row in x]
        return [e if e <= LONG else None for e in exact]


def _minus(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x - at in doubles: in integers where they hold the difference."""
    if int(np.abs(x >> 1).max(initial=0)) + int(np.abs(at >> 1).max(initial=0)) < 1 << 61:
        return (x - at).astype(float)
    return x.astype(float) - at.astype(float)


def _products(centre: Centre, turn: np.ndarray | None):
    """Sums of products of centred (and turned) vectors of one task, row by row of the matrix, and the sums themselves."""
    def run(batches):
        total = sums = None
        for _, x in _parts(batches, 0):
            z = centre.apart(x) if turn is None else centre.apart(x) @ turn
            total = z.T @ z if total is None else total + z.T @ z
            sums = z.sum(0) if sums is None else sums + z.sum(0)
        if total is not None:
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "p"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, -1), pa.int32()), pa.array(sums)], ["i", "j", "p"])

    return run


def _covariance(fit: DataFrame, centre: Centre, d: int, turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the fit list, or of its turned vectors; at most (d + 1) d numbers reach the driver."""
    rows = fit.mapInArrow(_products(centre, turn), "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    out, mean = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        if r["j"] < 0:
            mean[r["i"]] = r["p"] / centre.n
        else:
            out[r["i"], r["j"]] = r["p"] / centre.n
    return out - np.outer(mean, mean)


# ----------------------------------------------------------------------------- the operator
def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    v = F.col(vector_col)
    far = float(LONG - shift) / scale * (1 - 1e-15)
    fine = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < far))
    kept = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)))
    most = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = most[0]["d"] if most else 0
    x: Column = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift).cast("long"))
    return kept.filter(F.size("v") == d).select("vec_id", x.alias("x"))


def fitted(x: DataFrame, components: int = COMPONENTS) -> tuple[Centre, np.ndarray, np.ndarray, float, float] | None:
    """(centre, turn, eigenvalues, trace, identity error) of integer vectors; ``turn`` projects and scales. None: no vectors."""
    fit = written(x.select("x").distinct(), "whitening")
    sums = fit.mapInArrow(_summing, "dim int, s decimal(38,0), n long").groupBy("dim").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    if not sums:
        return None
    centre = Centre(int(sums[0]["n"]), [int(r["s"]) for r in sums])
    v = _covariance(fit, centre, len(sums))
    slicer = Slicer(v)
    pairs = slicer.leading(components, slicer.tiny * 16)
    values = np.array([e for e, _ in pairs])
    turn = np.array([q / np.sqrt(e) for e, q in pairs]).reshape(len(pairs), len(sums)).T
    after = _covariance(fit, centre, len(pairs), turn) if pairs else np.zeros((0, 0))
    return centre, turn, values, float(np.trace(v)), float(np.abs(after - np.eye(len(pairs))).max(initial=0.0))


def _whitening(centre: Centre, turn: np.ndarray, explained: np.ndarray, error: float, names: list[str]):
    def run(batches):
        for batch, x in _parts(batches, 1):
            k = turn.shape[1]
            z = centre.apart(x) @ turn
            of_row = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(centre.deviation(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(of_row)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(of_row), centre.n), pa.int64()), deviation.take(pa.array(of_row)), pa.array(z.ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(of_row), error))], names)

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    x = integers(vectors, id_col, vector_col, scale, shift)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fitted(x, components)
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    centre, turn, values, trace, error = model
    return x.mapInArrow(_whitening(centre, turn, values / trace if trace else values, error, names), schema)
