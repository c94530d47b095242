"""Embedding whitening with eigenpairs found by spectrum slicing.

Vectors become whole numbers ``floor(64 c) + 1000000``; the covariance is fitted on each
distinct vector once. Tasks sum counts, coordinates and products of what lies around the
rounded mean, so that sums are exact as long as they stay below 2**53; the driver gets
one d x d matrix, whatever the number of rows.

There, LDL' factors of the shifted covariance (1x1 and 2x2 pivots, complete pivoting)
count the eigenvalues above a shift, by the law of inertia. Counts isolate each leading
eigenvalue in an interval of its own, Rayleigh quotient iteration converges cubically
within it, and counts on both sides of what it found certify the eigenvalue's number.
Eigenvalues that rounding cannot tell apart share an interval; their vectors are an
orthogonal basis by inverse iteration.

Defined cases: vectors that are null, empty, hold null or non-finite entries or entries
whose whole number is beyond 2**62, or are not of the length that most distinct vectors
have take no part; repeated rows give repeated results and count once in the fit; null
ids are kept; eigenvalues of no size (at most 16 d eps of the largest bound) have no
component, so equal vectors, or a single one, give an empty result, as an empty table
does; a deviation beyond 64 bits is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from desense.llm.common import released, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows turned at a time.
ROWS = 4096
#: Growth bound of complete pivoting is least with this share.
ALPHA = (1 + 17**0.5) / 8
EPS = float(np.finfo(float).eps)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- eigenpairs -----------------------------------------------------------------------


def positive_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are over 0: the positive ones of D in its
    LDL' factors. A 2x2 pivot has one positive and one negative eigenvalue."""
    rest, positive = matrix.copy(), 0
    while len(rest):
        size = np.abs(rest)
        own = size.diagonal()
        p = int(own.argmax())
        apart = size.copy()
        np.fill_diagonal(apart, -1)
        r, q = divmod(int(apart.argmax()), len(rest))
        if max(own[p], apart[r, q]) <= 0:
            break
        chosen = [p] if own[p] >= ALPHA * apart[r, q] else [r, q]
        others = np.setdiff1d(np.arange(len(rest)), chosen)
        pivot = rest[np.ix_(chosen, chosen)]
        positive += 1 if len(chosen) == 2 else int(pivot[0, 0] > 0)
        column = rest[np.ix_(others, chosen)]
        rest = rest[np.ix_(others, others)] - column @ np.linalg.solve(pivot, column.T)
        rest = (rest + rest.T) / 2
    return positive


class Slices:
    """Counts of eigenvalues above shifts, each taken once, and the intervals they leave."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.eye = matrix, np.eye(len(matrix))
        self.bound = float(np.abs(matrix).sum(1).max())
        self.least = 16 * len(matrix) * EPS * self.bound
        self.counts = {-self.bound - self.least: len(matrix), self.bound + self.least: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positive_pivots(self.matrix - shift * self.eye)
        return self.counts[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The narrowest interval known to hold the k-th largest eigenvalue."""
        return max(s for s, n in self.counts.items() if n >= k), min(s for s, n in self.counts.items() if n < k)

    def isolated(self, k: int) -> tuple[float, float]:
        """One that holds no other, or is as narrow as rounding allows."""
        low, high = self.around(k)
        while (self.above(low) != k or self.above(high) != k - 1) and high - low > self.least:
            self.above((low + high) / 2)
            low, high = self.around(k)
        return low, high

    def solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0, 1, -2, 4):
            try:
                y = np.linalg.solve(self.matrix - (shift + nudge * EPS * self.bound) * self.eye, x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and y.any():
                return y / np.abs(y).max()
        raise ArithmeticError("no shift near the eigenvalue can be solved")


def leading_eigenpairs(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues over rounding's reach, by falling size, at most ``most``, and their unit
    vectors as rows."""
    slices = Slices(matrix)
    most = min(most, slices.above(slices.least)) if slices.bound > 0 else 0
    values, vectors = np.zeros(most), np.zeros((most, len(matrix)))
    for k in range(most):
        values[k], vectors[k] = _eigenpair(slices, k + 1, vectors[:k])
    return values, vectors


def _without(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    for _ in range(2):  # once leaves what cancellation brings in
        x = x - (found @ x) @ found
    return x / np.linalg.norm(x)


def _eigenpair(slices: Slices, k: int, found: np.ndarray) -> tuple[float, np.ndarray]:
    start = np.random.default_rng(k).standard_normal(len(slices.matrix))
    while True:
        low, high = slices.isolated(k)
        shift, x = (low + high) / 2, _without(start, found)
        for _ in range(3):  # inverse iteration brings the vector near
            x = _without(slices.solve(shift, x), found)
        value = float(x @ slices.matrix @ x)
        if high - low <= slices.least:  # a cluster: the interval itself is the certificate
            return value, x
        off = np.inf
        for _ in range(12):
            if not low < value <= high:
                break
            rest = float(np.linalg.norm(slices.matrix @ x - value * x))
            if rest >= off / 2:
                break
            off, best = rest, (value, x)
            x = slices.solve(value, x)
            x = x / np.linalg.norm(x)
            value = float(x @ slices.matrix @ x)
        if off <= slices.least:
            value, x = best
            near = max(2 * off, slices.least / 4)
            if slices.above(value - near) >= k and slices.above(value + near) < k:
                return value, x
        slices.above(shift)  # a narrower interval, then anew
        if slices.around(k) == (low, high):
            raise ArithmeticError(f"eigenvalue {k} was not certified")


# --- vectors as whole numbers ---------------------------------------------------------


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows that take part, their lengths, and ``floor(64 c)`` of all their
    entries one after another, as float64."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lengths = np.asarray(pc.list_value_length(column).drop_null(), np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    bad = ~(np.abs(values) < 2.0**62)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    good = (wrong[starts[1:]] == wrong[starts[:-1]]) & (lengths > 0)
    return rows[good], lengths[good], values[np.repeat(good, lengths)]


def coded(vector: np.ndarray) -> bytes:
    """The same bytes for the same vector: 16 bits an entry where all fit, else 64."""
    return vector.astype(np.int16 if np.abs(vector).max() < 2**15 else np.int64).tobytes()


def decoded(column: pa.Array, d: int) -> np.ndarray:
    """Whole numbers of coded vectors of length ``d``, as int64."""
    raw = column.to_pylist()
    out = np.zeros((len(raw), d), np.int64)
    for width, kind in ((2, np.int16), (8, np.int64)):
        at = [i for i, b in enumerate(raw) if len(b) == width * d]
        if at:
            out[at] = np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(-1, d)
    return out


def fit_list(vectors: DataFrame, column: str) -> DataFrame:
    """(d, x) of each distinct vector, coded; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, values = whole_vectors(batch.column(0))
            cuts = np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array([coded(v) for v in cuts], pa.binary())], names=["d", "x"])

    return written(vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "d int, x binary").distinct())


def summed(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of the matrices that ``of`` makes of several: each task sums
    what it reads, then each row of the matrix is summed where the shuffle brings it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = of(decoded(batch.column(0).slice(lo, ROWS), d))
                total = part if total is None else total + part
        if total is not None:
            yield _rows_of(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.array(row)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["i", "g"])

    kind = "i int, g array<double>"
    rows = fit.select("x").mapInArrow(run, kind).repartition("i").mapInArrow(added, kind).collect()
    return np.array([r["g"] for r in sorted(rows, key=lambda r: r["i"])])


def _rows_of(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(matrix)), pa.int32()), pa.array(matrix.tolist(), pa.list_(pa.float64()))], names=["i", "g"])


def exact_sums(fit: DataFrame, d: int) -> list[int]:
    """The sum of each entry over all vectors, without ``SHIFT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = decoded(batch.column(0).slice(lo, ROWS), d)
                total += (x if np.abs(x).max() < 2**48 else x.astype(object)).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def covariance(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Of the distinct vectors, divisor n; products are taken around the rounded mean and
    put right by exact fractions."""
    middle = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(middle, np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - centre).astype(np.float64)
        return y.T @ y

    gram = summed(fit, d, products)
    left = [s - n * m for s, m in zip(sums, middle, strict=True)]
    return np.array([[(n * int(gram[i, j]) - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)])


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each
    vector that takes part and each component."""
    spark = vectors.sparkSession
    fit = fit_list(vectors, column)
    lengths = fit.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    d, n = lengths[0]["d"], lengths[0]["count"]
    fit = (whole := fit).where(F.col("d") == d)
    sums = exact_sums(fit, d)
    v = covariance(fit, d, n, sums)
    values, axes = leading_eigenpairs(v, components)
    k, scale = len(values), np.sqrt(values)
    if not k:
        return spark.createDataFrame([], RESULT)

    def around_mean(x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums)) // n + 1) < 2**62:
            return n * x - np.array(sums, np.int64)
        return n * x.astype(object) - np.array(sums, object)

    def turned(off: np.ndarray) -> np.ndarray:
        return (off / n).astype(np.float64) @ axes.T / scale

    def moments(x: np.ndarray) -> np.ndarray:
        w = turned(around_mean(x))
        return np.concatenate([w.T @ w, w.sum(0)[None]])

    total = summed(fit, d, moments) / n
    released(whole)
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    explained = values / np.trace(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rows, lengths, values = whole_vectors(part.column("v"))
                rows, x = rows[lengths == d], values[np.repeat(lengths == d, lengths)].reshape(-1, d).astype(np.int64)
                off = around_mean(x)
                if np.abs(off.astype(np.float64)).max(initial=0) ** 2 * d < 2.0**62:
                    deviation = pa.array(((off.astype(np.int64)) ** 2).sum(1), pa.int64())
                else:
                    exact = (off.astype(object) ** 2).sum(1)
                    deviation = pa.array([int(e) if e < 2**63 else None for e in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                m = len(rows) * k
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, n, np.int64)),
                    deviation.take(each), pa.array(turned(off).reshape(-1)), pa.array(np.tile(explained, len(rows))), pa.array(np.full(m, error)),
                ], names=[c.split()[0] for c in RESULT.split(", ")])

    return vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, RESULT)
