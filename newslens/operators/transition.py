"""Linear transition T = pinv(A) B from one QR pass, and the projection A T."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# How much each folding step narrows, and the most factors that reach the driver.
FAN_IN, DRIVER_FACTORS = 64, 16
SLICE = 1024  # rows of a batch turned into doubles at a time
ROUNDING = 1e-13  # what centring leaves of a constant column, relative to the column
FACTOR = "rows int, r array<double>"


def _matrix(lists: pa.Array) -> np.ndarray:
    if lists.null_count or lists.flatten().null_count:
        raise ValueError("vectors must not hold NULL")
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors must have one length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _emit(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_pydict({"rows": pa.array([r.shape[0]], pa.int32()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})


def _factor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    r = None
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            m = np.hstack([_matrix(c) for c in batch.slice(i, SLICE).columns])
            r = np.linalg.qr(m if r is None else np.vstack([r, m]), mode="r")
    yield from _emit(r)


def _fold_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    r = None
    for batch in batches:
        for rows, flat in zip(batch.column(0).to_pylist(), batch.column(1)):
            m = flat.values.to_numpy().reshape(rows, -1)
            r = m if r is None else np.linalg.qr(np.vstack([r, m]), mode="r")
    yield from _emit(r)


def _triangle(df: DataFrame, *arrays: Column) -> np.ndarray:
    """Triangular factor of the rows made of ``arrays`` side by side.

    Tall-skinny QR: each task keeps one triangular factor, as wide as a row, factors are
    folded in ever fewer tasks, and at most 16 of them reach the driver.
    """
    wide = df.select(*[a.alias(f"_{i}") for i, a in enumerate(arrays)])
    factors = wide.mapInArrow(_factor_rows, FACTOR)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        parts = -(-parts // FAN_IN)
        factors = factors.repartition(parts).mapInArrow(_fold_factors, FACTOR)
        if parts <= DRIVER_FACTORS:
            break
    stack = [np.array(r.r).reshape(r.rows, -1) for r in factors.collect()]
    if not stack:
        raise ValueError("no rows to fit a transition on")
    return np.linalg.qr(np.vstack(stack), mode="r")


def _solve(r: np.ndarray, targets: int, tol: float) -> np.ndarray:
    k = r.shape[1] - targets
    if k <= 0:
        raise ValueError("empty vectors in the source space")
    return np.linalg.pinv(r[:, :k], rcond=tol) @ r[:, k:]


def _targets(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def fit_transition(df: DataFrame, a: str, features: Sequence[str], tol: float = 1.0e-8) -> np.ndarray:
    """T of shape (k, number of features); singular values below ``tol`` times the largest are cut.

    One pass for the factor of [A | B]. The condition number is not squared, as it would be by normal equations.
    """
    return _solve(_triangle(df, F.col(a), _targets(features)), len(features), tol)


def fit_centred_transition(df: DataFrame, a: str, features: Sequence[str], tol: float = 1.0e-8) -> tuple[np.ndarray, np.ndarray]:
    """``(T, mean)`` with A centred by its mean over the rows of ``df``, from the same single pass.

    The factor is taken of [1 | A | B]. Its first row holds the means; what is left below is the factor of A and B
    without their components along the ones, which are the centred columns. The
    pseudo-inverse of centred A gives the same T for B as for centred B, as it is blind to the ones.
    """
    r = _triangle(df, F.array(F.lit(1.0)), F.col(a), _targets(features))
    k = r.shape[1] - 1 - len(features)
    left = np.where(np.abs(r) > ROUNDING * np.linalg.norm(r, axis=0), r, 0.0)[1:, 1:]
    return _solve(left, len(features), tol), r[0, 1 : 1 + k] / r[0, 0]


def transition_table(spark, t: np.ndarray, features: Sequence[str]) -> DataFrame:
    """T as ``(dim, feature, weight)``."""
    rows = [(i, f, float(t[i, j])) for i in range(t.shape[0]) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "dim int, feature string, weight double")


def project(vector: Column, t: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """``array<double>`` A T per row, or (A - mean) T; T is at most 512 x 8 numbers and travels with the task."""
    shift = 0.0 if mean is None else mean

    def times(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [(_matrix(batch[i : i + SLICE]) - shift) @ t for i in range(0, len(batch), SLICE)]
            out = np.vstack(parts) if parts else np.zeros((0, t.shape[1]))
            offsets = pa.array(np.arange(0, out.size + 1, t.shape[1], dtype=np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return F.arrow_udf(times, ArrayType(DoubleType()))(vector)


def with_projection(df: DataFrame, a: str, t: np.ndarray, features: Sequence[str], suffix: str = "_hat", mean: np.ndarray | None = None) -> DataFrame:
    projected = df.withColumn("_p", project(F.col(a), t, mean))
    return projected.withColumns({f"{c}{suffix}": F.col("_p")[i] for i, c in enumerate(features)}).drop("_p")

