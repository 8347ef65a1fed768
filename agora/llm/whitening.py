"""Whitening of embeddings: exact covariance, eigenvectors refined from single precision.

The covariance is summed by Spark: counts and sums first, then products of vectors centred at
the rounded mean, all of them integers, so no digit is lost and the order of tasks doesn't
matter. What remains of the centre is taken off exactly at the end.

Its eigenvectors are computed once in float32 and corrected in extended precision by the
matrix-multiplication iteration of Ogita and Aishima (2018), which doubles the right digits
each time where eigenvalues lie apart. Eigenvectors of eigenvalues too close for that span a
subspace; once this is right, a sub-solve of the matrix projected on it, shifted by its mean
eigenvalue, parts them (Ogita and Aishima, 2019), and the iteration goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
#: A scaled entry of this size or more has lost its last digit as a double: it counts as not finite.
TOO_LARGE = 2.0**53
#: Products of two parts of this many bits, and this many of them, add up exactly as doubles.
PART_BITS, PART_ROWS = 20, 4_096
#: More rounds than quadratic convergence needs from single precision.
ROUNDS = 40

Wide = np.longdouble


def integer_vectors(column: pa.Array, scale: int = SCALE, offset: int = OFFSET) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): the usable rows of a column of vectors, scaled to 64-bit integers."""
    places = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    lists = column.filter(pc.is_valid(column))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes not-a-number
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * flat)
    ends = np.cumsum(sizes)
    strange = np.concatenate([[0], np.cumsum(~(np.abs(flat) < TOO_LARGE))])
    usable = strange[ends] == strange[ends - sizes]
    if not usable.any():
        return places[:0], np.empty((0, 0), dtype=np.int64)
    width = np.unique(sizes[usable])
    if len(width) > 1:
        raise ValueError(f"vectors of different lengths: {width.tolist()}")
    rows = (ends - sizes)[usable][:, None] + np.arange(width[0])
    return places[usable], flat[rows].astype(np.int64) + offset


def exact_products(rows: np.ndarray) -> np.ndarray:
    """The sum of products of every two columns, as Python integers."""
    total = np.zeros((rows.shape[1], rows.shape[1]), dtype=object)
    for start in range(0, len(rows), PART_ROWS):
        left, parts = rows[start : start + PART_ROWS], []
        while left.any() and (not parts or np.any(left)):
            low = left & ((1 << PART_BITS) - 1)
            low = low - ((low >> (PART_BITS - 1)) << PART_BITS)  # -2**19 up to below 2**19
            parts.append(low.astype(np.float64))
            left = (left - low) >> PART_BITS
        for a, first in enumerate(parts):
            for b, second in enumerate(parts):
                total += (first.T @ second).astype(np.int64).astype(object) << (PART_BITS * (a + b))
    return total


def _summed(partial: DataFrame) -> dict[int, int]:
    """Sums per cell: one row per cell and task is shuffled, one per cell collected."""
    rows = partial.groupBy("cell").agg(F.sum("value").alias("value")).collect()
    return {row["cell"]: int(row["value"]) for row in rows}


def _cells(values) -> pa.RecordBatch:
    cells = pa.array(np.arange(len(values)), pa.int64())
    return pa.RecordBatch.from_arrays([cells, pa.array([int(v) for v in values], pa.decimal128(38, 0))], ["cell", "value"])


_CELLS = "cell bigint, value decimal(38,0)"


def moments(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> tuple[int, list[int], list[list[Fraction]]]:
    """(n, sums, covariance) of the usable vectors, exact; the divisor is n."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, 0
        for batch in batches:
            rows = integer_vectors(batch.column(0), scale, offset)[1]
            if len(rows):
                count += len(rows)
                total = total + (rows >> 32).sum(axis=0).astype(object) * (1 << 32) + (rows & 0xFFFFFFFF).sum(axis=0).astype(object)
        if count:
            yield _cells([count, *total])

    slim = vectors.select("embedding")
    found = _summed(slim.mapInArrow(sums, _CELLS))
    if len(found) < 2:
        return found.get(0, 0), [], []
    n, total = found[0], [found[k] for k in range(1, len(found))]
    width = len(total)
    centre = rounded_means(n, total)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, sum_here = np.triu_indices(width), 0
        for batch in batches:
            rows = integer_vectors(batch.column(0), scale, offset)[1]
            if len(rows):
                sum_here = sum_here + exact_products(rows - centre)
        if not isinstance(sum_here, int):
            yield _cells(sum_here[upper])

    cells = _summed(slim.mapInArrow(products, _CELLS))
    left = [s - n * int(c) for s, c in zip(total, centre)]
    covariance = [[Fraction(0)] * width for _ in range(width)]
    for cell, (i, j) in enumerate(zip(*np.triu_indices(width))):
        covariance[i][j] = covariance[j][i] = Fraction(n * cells[cell] - left[i] * left[j], n * n)
    return n, total, covariance


def rounded_means(n: int, sums: list[int]) -> np.ndarray:
    return np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)


def _wide(value: Fraction) -> Wide:
    """An exact value in extended precision: its double and the double of what that leaves."""
    double = value.numerator / value.denominator
    return Wide(double) + Wide(float(value - Fraction(double)))


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of sorted values, cut wherever neighbours are further apart than ``gap``."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.abs(np.diff(values)) > gap) + 1)


def refined(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    matrix = matrix.astype(Wide)
    size = len(matrix)
    scale = np.abs(matrix).max()
    if scale == 0:
        return np.zeros(size, dtype=Wide), np.eye(size, dtype=Wide)
    matrix = matrix / scale
    vectors = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1].astype(Wide)
    tiny = np.finfo(Wide).eps * size
    previous = np.inf
    for _ in range(ROUNDS):
        values, vectors, change = _corrected(matrix, vectors)
        if change <= tiny or (change < 1e-12 and change >= previous):
            break
        previous = change
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    return values * scale, vectors / np.sqrt((vectors * vectors).sum(axis=0))


def _measured(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What lacks to orthogonality, the projected matrix, the eigenvalues, and their resolution.

    Differences of eigenvalues below the resolution can't be told from errors of the vectors.
    """
    lack, projected = np.eye(len(matrix)) - vectors.T @ vectors, vectors.T @ matrix @ vectors
    # Symmetric but for rounding, which a division by close eigenvalues would blow up.
    lack, projected = (lack + lack.T) / 2, (projected + projected.T) / 2
    values = np.diag(projected) / (1 - np.diag(lack))
    off = projected - np.diag(values)
    return lack, projected, values, 2 * float(np.linalg.norm(off.astype(float), 2) + np.linalg.norm(lack.astype(float), 2))


def _corrected(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: better vectors, their eigenvalues before it, and the size of the correction."""
    vectors = _parted(matrix, vectors)
    lack, projected, values, gap = _measured(matrix, vectors)
    apart = values[None, :] - values[:, None]
    clear = np.abs(apart) > gap
    correction = np.where(clear, (projected + values[None, :] * lack) / np.where(clear, apart, 1), lack / 2)
    return values, vectors + vectors @ correction, float(np.abs(correction).max())


def _parted(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vectors, those of clustered eigenvalues turned by a sub-solve inside their subspace."""
    values, gap = _measured(matrix, vectors)[2:]
    order = np.argsort(-values)
    vectors, values = vectors[:, order].copy(), values[order]
    for places in _clusters(values, gap):
        if len(places) < 2:
            continue
        span = vectors[:, places]
        shifted = matrix - np.mean(values[places]) * np.eye(len(matrix))
        small = span.T @ shifted @ span
        small = (small + small.T) / 2
        turn = np.linalg.eigh((small / max(np.abs(small).max(), np.finfo(Wide).tiny)).astype(float))[1][:, ::-1]
        vectors[:, places] = span @ turn.astype(Wide)
    return vectors


def whitened(
    spark: SparkSession,
    vectors: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """Every usable vector on the first principal components, scaled to variance 1.

    ``vectors`` has vec_id and embedding. Returns per row and component ``vec_id, component, n,
    deviation, whitened, explained, identity_error``; deviation is a decimal of 38 digits.

    Rows with a null vector, or a null, not finite or huge entry (2**53 or more after scaling)
    are dropped. Every other row counts by itself, under whatever id: repeated rows weigh as
    often as they occur. Where an eigenvalue is zero but for rounding, as for a single row or
    fewer rows than dimensions, ``whitened`` is null. Empty tables and vectors of length zero
    give no rows. Vectors of different lengths have no covariance: they are an error. Other
    columns are ignored. A component points where its largest entry is positive.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    n, sums, covariance = moments(vectors, scale, offset)
    if not sums:
        return spark.createDataFrame([], schema)
    values, basis = refined(np.array([[_wide(v) for v in row] for row in covariance], dtype=Wide))
    count = min(components, len(values))
    trace = _wide(sum((covariance[k][k] for k in range(len(values))), Fraction(0)))
    full = values[:count] > values[0] * len(values) * np.finfo(float).eps
    largest = np.abs(basis).argmax(axis=0)
    basis = basis * np.where(basis[largest, np.arange(len(values))] < 0, -1, 1)
    frame = basis[:, :count] / np.sqrt(np.where(full, values[:count], 1))
    centre = rounded_means(n, sums)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=object)
    facts = {
        "centre": centre,
        "frame": np.where(full, frame, 0).astype(float),
        "left": np.array([float(Fraction(int(r), n)) for r in rest]),
    }

    def projected(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places, rows = integer_vectors(column, scale, offset)
        if not len(rows):
            return places, rows, np.empty((0, count))
        rows = rows - facts["centre"]
        return places, rows, (rows - facts["left"]) @ facts["frame"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((count + 1, count + 1)), 0
        for batch in batches:
            points = projected(batch.column(0))[2]
            padded = np.hstack([np.ones((len(points), 1)), points])
            total, weight = total + padded.T @ padded, weight + len(points)
        if weight:
            cells = pa.array(np.arange(total.size), pa.int64())
            yield pa.RecordBatch.from_arrays([cells, pa.array(total.reshape(-1))], ["cell", "value"])

    slim = vectors.select("embedding").mapInArrow(spread, "cell bigint, value double")
    found = np.zeros((count + 1) ** 2)
    for cell, value in slim.groupBy("cell").agg(F.sum("value")).collect():  # a few sums
        found[cell] = value / n
    found = found.reshape(count + 1, count + 1)
    # The points are centred already; what rounding left of their mean is taken off.
    measured = found[1:, 1:] - np.outer(found[0, 1:], found[0, 1:])
    error = float(np.abs((measured - np.eye(count))[np.ix_(full, full)]).max(initial=0))
    explained = [float(v / trace) if trace else 0.0 for v in values[:count]]

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows, points = projected(batch.column(1))
            if not len(rows):
                continue
            distance = deviations(rows, n, rest)
            again = np.repeat(np.arange(len(rows)), count)
            shown = pa.array(points.reshape(-1), mask=np.tile(~full, len(rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(places[again])),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(again), n)),
                    distance.take(pa.array(again)),
                    shown,
                    pa.array(np.tile(np.array(explained), len(rows))),
                    pa.array(np.full(len(again), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select("vec_id", "embedding").mapInArrow(rows_out, schema)


def deviations(rows: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Per row the sum of squares of n times the entries less their sums, exact."""
    bound = n * int(np.abs(rows).max(initial=0)) + max(map(abs, rest))
    if bound * bound * rows.shape[1] < 2**63:
        apart = n * rows - rest.astype(np.int64)
        return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
    apart = n * rows.astype(object) - rest
    total = (apart * apart).sum(axis=1)
    return pa.array([int(v) if v < 10**38 else None for v in total], pa.decimal128(38, 0))
