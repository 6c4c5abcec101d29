"""Whitening of embeddings by principal components that FEAST contour integration finds."""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null
from loreloom.session import shared_folder

COMPONENTS = 4
#: Points of the half contour about an interval.
NODES = 8
#: Dimensions of the covariance the driver may hold: 512 MB.
MOST_DIMENSIONS = 8192
_LONG = 2**63 - 1


# ---- the matrix: inertia, contours, Rayleigh-Ritz ----------------------------------------------------------------------

def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """(negative, zero, positive) eigenvalues of a symmetric matrix, by Sylvester's law from the pivots of an L D L'
    factorisation with complete diagonal pivoting: a pivot is one number, or two by two with one eigenvalue of each sign."""
    rest = np.array(matrix, float)
    negative = positive = 0
    bound = (1 + math.sqrt(17)) / 8
    while len(rest):
        sizes = np.abs(rest)
        p = int(np.argmax(np.diag(sizes)))
        if sizes.max() == 0:
            break
        if sizes[p, p] >= bound * sizes.max():
            pivot = rest[p, p]
            negative, positive = negative + (pivot < 0), positive + (pivot > 0)
            column = np.delete(rest[:, p], p)
            rest = np.delete(np.delete(rest, p, 0), p, 1) - np.outer(column, column / pivot)
        else:
            np.fill_diagonal(sizes, 0)
            i, j = np.unravel_index(int(np.argmax(sizes)), sizes.shape)
            negative, positive = negative + 1, positive + 1
            pair = [int(i), int(j)]
            block = rest[np.ix_(pair, pair)]
            columns = np.delete(rest[:, pair], pair, 0)
            rest = np.delete(np.delete(rest, pair, 0), pair, 1) - columns @ np.linalg.solve(block, columns.T)
        rest = (rest + rest.T) / 2
    return int(negative), len(matrix) - int(negative) - int(positive), int(positive)


class Interval(NamedTuple):
    low: float
    high: float
    count: int


def eigenvalue_intervals(matrix: np.ndarray, most: int, tolerance: float = 1e-2) -> list[Interval]:
    """Intervals that together hold the ``most`` largest eigenvalues, falling, with the number in each by inertia counts.

    Each eigenvalue is bracketed by bisecting with counts. Intervals end in the middle of gaps between brackets, so that
    eigenvalues closer than ``tolerance`` of the largest share one; the last may hold more than asked for."""
    n = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)  # Gershgorin
    counted: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counted:
            negative, zero, positive = inertia(matrix - shift * np.eye(n))
            counted[shift] = positive
        return counted[shift]

    bottom = -top
    brackets: list[tuple[float, float]] = []
    for k in range(1, n + 1):
        # The k-th largest eigenvalue lies where the count above falls below k.
        low = max([s for s, c in counted.items() if c >= k], default=bottom)
        high = min([s for s, c in counted.items() if c < k], default=top)
        while high - low > tolerance * top / 4:
            middle = (low + high) / 2
            if above(middle) >= k:
                low = middle
            else:
                high = middle
        brackets.append((low, high))
        # Enough, once the last one asked for is separate from the next.
        if k > most and brackets[-1][1] < brackets[-2][0]:
            break
    intervals, start, edge = [], 0, top
    for k in range(1, len(brackets) + 1):
        last = k == len(brackets)
        if last or brackets[k][1] < brackets[k - 1][0]:
            low = bottom if last else (brackets[k][1] + brackets[k - 1][0]) / 2
            inside = (n if last else above(low)) - start
            intervals.append(Interval(low, edge, inside))
            start, edge = start + inside, low
            if start >= most:
                break
    return intervals


def contour(interval: Interval, nodes: int = NODES) -> list[tuple[complex, complex]]:
    """(point, weight) of Gauss-Legendre quadrature along the upper half circle about an interval."""
    centre, radius = (interval.low + interval.high) / 2, (interval.high - interval.low) / 2
    x, w = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2 * (1 - x))
    return list(zip((centre + radius * turn).tolist(), (radius * turn * w / 2).tolist(), strict=True))


def _solve(matrix: np.ndarray, point: complex, weight: complex, block: np.ndarray) -> np.ndarray:
    """One point's share of the projection of ``block`` onto the eigenvectors inside its contour."""
    return (weight * np.linalg.solve(point * np.eye(len(matrix)) - matrix, block)).real


def _project(spark, matrix: np.ndarray, work: list[tuple[int, complex, complex]], blocks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sums over the contours' points of all intervals in ``work``; one task solves for one point."""
    shared = spark.sparkContext.broadcast((matrix, blocks))

    def run(batches):
        matrix, blocks = shared.value
        for batch in batches:
            for i, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                share = _solve(matrix, complex(*parts[:2]), complex(*parts[2:]), blocks[i])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([share.ravel().tolist()])], names=["i", "share"])

    points = spark.createDataFrame([(i, z.real, z.imag, w.real, w.imag) for i, z, w in work],
                                   "i bigint, x double, y double, u double, v double").repartition(min(len(work), 64))
    shares = points.mapInArrow(run, "i bigint, share array<double>").toArrow()
    total = {i: np.zeros_like(b) for i, b in blocks.items()}
    # In a fixed order: sums must not depend on which task ends first.
    for i, share in sorted(zip(shares["i"].to_pylist(), shares["share"].to_pylist(), strict=True)):
        total[i] += np.reshape(share, total[i].shape)
    shared.destroy()
    return total


def largest_eigenpairs(spark, matrix: np.ndarray, most: int, rounds: int = 30, exact: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors (columns).

    FEAST: on each interval a block is projected by a contour integral of shifted solves and rotated to Ritz vectors,
    until those inside are as many as inertia counts and their residuals are below ``exact`` of the matrix. An interval
    that doesn't get there is given a wider block, at last one of all dimensions, whose Ritz vectors are eigenvectors.
    Equal eigenvalues: any orthonormal vectors of their space."""
    n = len(matrix)
    scale = float(np.abs(matrix).max())
    if scale == 0:
        return np.zeros(min(most, n)), np.eye(n)[:, :most]
    scaled = matrix / scale
    intervals = eigenvalue_intervals(scaled, min(most, n))
    random = np.random.default_rng(11)
    width = {i: min(n, 2 * x.count + 4) for i, x in enumerate(intervals)}
    blocks = {i: random.standard_normal((n, w)) for i, w in width.items()}
    found: dict[int, np.ndarray] = {}
    norm = float(np.linalg.norm(scaled))
    for step in range(1, rounds + 1):
        open_ = [i for i in blocks if i not in found]
        if not open_:
            break
        projected = _project(spark, scaled, [(i, z, w) for i in open_ for z, w in contour(intervals[i])], {i: blocks[i] for i in open_})
        for i in open_:
            low, high, count = intervals[i]
            basis = np.linalg.qr(projected[i] if width[i] < n else blocks[i])[0]
            values, turn = np.linalg.eigh(basis.T @ scaled @ basis)
            ritz = basis @ turn
            inside = (values >= low) & (values <= high)
            residuals = np.linalg.norm(scaled @ ritz[:, inside] - ritz[:, inside] * values[inside], axis=0)
            if width[i] == n or (inside.sum() == count and (residuals <= exact * norm).all()):
                if inside.sum() != count:
                    raise ArithmeticError(f"{inside.sum()} eigenvalues in an interval of {count}")
                found[i] = ritz[:, inside]
            elif step % 6 == 0:
                width[i] = min(n, 2 * width[i])
                blocks[i] = np.hstack((ritz, random.standard_normal((n, width[i] - ritz.shape[1]))))
            else:
                blocks[i] = ritz
    if len(found) < len(intervals):
        raise ArithmeticError("contour integration did not settle")
    # All components at once: orthonormal across intervals too.
    basis = np.linalg.qr(np.hstack([found[i] for i in range(len(intervals))]))[0]
    values, turn = np.linalg.eigh(basis.T @ scaled @ basis)
    order = np.argsort(values)[::-1][:most]
    return values[order] * scale, (basis @ turn)[:, order]


# ---- the vectors -------------------------------------------------------------------------------------------------------

def _vectors(rows: DataFrame, identifier: str, vector: str) -> DataFrame:
    return rows.select(column_or_null(rows, identifier, "bigint").alias("vec_id"),
                       column_or_null(rows, vector, "array<double>").alias("embedding"))


def _whole(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch with usable vectors, by length: (places, x as a matrix of int64)."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    numbers = values.to_numpy(zero_copy_only=False)
    good = np.isfinite(numbers)  # nulls are NaN
    wrong = np.concatenate(([0], np.cumsum(~good)))
    size = np.diff(offsets)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    out = []
    for length in np.unique(size[usable]).tolist():
        places = np.flatnonzero(usable & (size == length))
        steps = np.floor(256.0 * numbers[offsets[places][:, None] + np.arange(length)])
        # Steps beyond the range of a long become its ends.
        x = np.where(steps >= 2.0**63, _LONG, np.where(steps < -2.0**63, -2**63, 0)).astype(np.int64)
        inside = np.abs(steps) < 2.0**63
        x[inside] = steps[inside].astype(np.int64)
        out.append((places, x))
    return out


def _narrowest(x: np.ndarray) -> list[bytes]:
    """Each row of x as numbers of the fewest bytes (2, 4 or 8) that hold it."""
    out = [b""] * len(x)
    least, most = x.min(axis=1), x.max(axis=1)
    rest = np.ones(len(x), bool)
    for kind in ("<i2", "<i4", "<i8"):
        info = np.iinfo(kind)
        now = rest & (least >= info.min) & (most <= info.max)
        for place, row in zip(np.flatnonzero(now).tolist(), x[now].astype(kind), strict=True):
            out[place] = row.tobytes()
        rest &= ~now
    return out


def _matrix(vectors: pa.Array, length: int) -> np.ndarray:
    rows = [v.as_buffer() for v in vectors]
    return np.array([np.frombuffer(r, f"<i{r.size // length}") for r in rows], np.int64).reshape(len(rows), length)


class Fit(NamedTuple):
    length: int
    n: int
    sums: list[int]         # S, exact
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray     # columns
    identity_error: float | None


def _distinct(rows: DataFrame) -> DataFrame:
    """(length, x) of each distinct vector."""

    def run(batches):
        for batch in batches:
            for _, x in _whole(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(_narrowest(x), pa.binary())],
                                                 names=["length", "x"])

    return rows.mapInArrow(run, "length int, x binary").distinct()


def _column_sums(fit: DataFrame, length: int) -> list[int]:
    """Exact sums of each dimension: two halves of every number are added up on their own, so neither can overflow."""

    def run(batches):
        high, low = np.zeros(length, np.int64), np.zeros(length, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), length)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    sums = fit.select("x").mapInArrow(run, "i bigint, high bigint, low bigint").groupBy("i").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    return [int(r.high) * 2**32 + int(r.low) for r in sorted(sums, key=lambda r: r.i)]


def _second_moments(fit: DataFrame, length: int, size: int, of) -> np.ndarray:
    """Sum over all vectors x of y y', where y = of(x) has ``size`` entries and is centred. Partial sums of tasks are added
    up by a shuffle; the driver gets the matrix."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            y = of(_matrix(batch.column(0), length))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    cells = fit.select("x").mapInArrow(run, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "value")) \
        .groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((size, size))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["value"].to_numpy()
    return (out + out.T) / 2


def fit_whitening(rows: DataFrame, identifier: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Mean, covariance and largest components of each distinct vector once; None without any usable vector.

    Vectors of the commonest length among the distinct ones count (ties: the longest)."""
    spark = rows.sparkSession
    found = _distinct(_vectors(rows, identifier, vector))
    path = f"{shared_folder(spark)}/distinct-vectors-{uuid.uuid4().hex}"
    found.write.option("compression", "zstd").parquet(path)
    fit = spark.read.schema(found.schema).parquet(path)
    lengths = fit.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return None
    length, n = lengths["length"], lengths["count"]
    if length > MOST_DIMENSIONS:
        raise ValueError(f"a covariance of {length} dimensions is too large for the driver")
    fit = fit.where(F.col("length") == length)
    sums = _column_sums(fit, length)
    mean = np.array([s / n for s in sums])
    covariance = _second_moments(fit, length, length, lambda x: x - mean) / n
    values, vectors = largest_eigenpairs(spark, covariance, components)
    some = values > length * np.finfo(float).eps * max(float(np.trace(covariance)), np.finfo(float).tiny)
    values = np.where(some, values, 0.0)
    error = None
    if some.any():
        turn = vectors[:, some] / np.sqrt(values[some])
        whitened = _second_moments(fit, length, int(some.sum()), lambda x: (x - mean) @ turn) / n
        error = float(np.abs(whitened - np.eye(int(some.sum()))).max())
    return Fit(length, n, sums, covariance, values, vectors, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n x - S)**2 for each row; None where it is no long.

    It is n**2 sum(x**2) - 2 n sum(x S) + sum(S**2); the sums are taken in 64 bits where they fit."""
    widest = int(max(abs(int(x.min())), abs(int(x.max())), 1)) if x.size else 1
    largest = max((abs(s) for s in sums), default=0)
    if x.shape[1] * widest * max(widest, largest) < _LONG and largest < _LONG:
        squares, products = (x * x).sum(axis=1).tolist(), (x @ np.array(sums, np.int64)).tolist()
    else:
        wide = x.astype(object)
        squares, products = (wide * wide).sum(axis=1).tolist(), (wide @ np.array(sums, object)).tolist()
    own = sum(s * s for s in sums)
    found = [n * n * a - 2 * n * b + own for a, b in zip(squares, products, strict=True)]
    return [v if v <= _LONG else None for v in found]


def whitened(rows: DataFrame, identifier: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, holds nulls or numbers that are not finite, or has another length than the fit's are
    left out. Numbers beyond the range of a long after scaling become its ends. Repeated rows stay; they count once in the
    fit. A component without variance (all vectors equal, or too few) has whitened null and explained 0; identity_error is
    taken over the others, null without any. deviation is null where it is no long. Fewer dimensions than components: as
    many components. Other columns are ignored; an empty table gives an empty table.
    """
    spark = rows.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = fit_whitening(rows, identifier, vector, components)
    if fit is None:
        return spark.createDataFrame([], schema)
    mean = np.array([s / fit.n for s in fit.sums])
    trace = float(np.trace(fit.covariance))
    some = fit.values > 0
    turn = fit.vectors / np.sqrt(np.where(some, fit.values, 1.0))
    explained = fit.values / trace if trace else np.zeros(len(fit.values))
    length, n, sums, error, count = fit.length, fit.n, fit.sums, fit.identity_error, len(fit.values)

    def run(batches):
        for batch in batches:
            for places, x in _whole(batch):
                if x.shape[1] != length:
                    continue
                rows_out = len(x) * count
                values = ((x - mean) @ turn).ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(places, count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows_out, n)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), count))),
                    pa.array(values, mask=~np.tile(some, len(x))), pa.array(np.tile(explained, len(x))),
                    pa.array([error] * rows_out, pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _vectors(rows, identifier, vector).mapInArrow(run, schema)
