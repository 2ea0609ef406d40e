"""How well projected features keep the pairwise distances of the measured ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a block: 2,048 up to 24 blocks, then fuller ones, then more blocks. Distances held at a time: STEP x WIDTH.
BLOCK, FULL_BLOCKS, LARGEST_BLOCK = 2048, 24, 65_536
STEP, WIDTH = 128, 1024
SUMS = "n double, x double, y double, xx double, yy double, xy double"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sides(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Both sides moved by the mean of the left one, which no distance sees, and their squared lengths."""
    mean = left.mean(axis=0)
    left, right = left - mean, right - mean
    return left, right, np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)


def _squares(sides: tuple[np.ndarray, ...], i: int, j: int) -> np.ndarray:
    left, right, ll, rr = sides
    out = left[i : i + STEP] @ right[j : j + WIDTH].T
    out *= -2.0
    out += ll[i : i + STEP, None]
    out += rr[None, j : j + WIDTH]
    return np.maximum(out, 0.0, out=out)


def _block_sums(group: pa.Table) -> pa.Table:
    """Sums over the pairs of two blocks, or over the pairs inside one block (all ordered pairs, halved)."""
    same = group.column("bi")[0] == group.column("bj")[0]
    own = group.column("left").to_numpy()
    b, h = (_matrix(group.column(c).combine_chunks()) for c in ("b", "h"))
    total = np.zeros(6)
    left, right = (np.ones(len(own), bool),) * 2 if same else (own, ~own)
    n, m = np.count_nonzero(left), np.count_nonzero(right)
    if n and m:
        first, second = _sides(b[left], b[right]), _sides(h[left], h[right])
        for i in range(0, n, STEP):
            for j in range(0, m, WIDTH):
                xx, yy = _squares(first, i, j), _squares(second, i, j)
                if same:
                    k = np.arange(max(i, j), max(max(i, j), min(i + STEP, j + WIDTH, n)))
                    xx[k - i, k - j] = yy[k - i, k - j] = 0.0
                x, y = np.sqrt(xx), np.sqrt(yy)
                total += [0.0, x.sum(), y.sum(), xx.sum(), yy.sum(), np.vdot(x, y)]
        total = total / 2 if same else total
        total[0] = n * (n - 1) / 2 if same else float(n) * m
    return pa.table([pa.array([t]) for t in total], names=["n", "x", "y", "xx", "yy", "xy"])


def distance_correlation(df: DataFrame, features: Sequence[str], projected: Sequence[str], id_col: str = "id") -> DataFrame:
    """Pearson correlation of Euclidean distances over all pairs of rows, in one row.

    All pairs enter. Rows are hashed into blocks; one task takes one pair of blocks and returns six sums, so no pair
    ever leaves a task and memory is bounded by two blocks. Distances come from matrix products. The work itself grows
    with the square of the rows, as the measure is defined. The correlation is null where a feature is null or not finite.
    """
    n = df.count()
    blocks = max(1, -(-n // min(max(n // FULL_BLOCKS, BLOCK), max(BLOCK, LARGEST_BLOCK))))
    rows = df.select(
        F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("own"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("b"),
        F.array(*[F.col(c).cast("double") for c in projected]).alias("h"),
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paired = rows.select(
        F.least("own", "other").alias("bi"),
        F.greatest("own", "other").alias("bj"),
        (F.col("own") <= F.col("other")).alias("left"),
        "b",
        "h",
    )
    sums = paired.groupBy("bi", "bj").applyInArrow(_block_sums, SUMS)
    total = sums.agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    var = F.sqrt(F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * F.sqrt(F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    pearson = cov / F.nullif(var, F.lit(0.0))
    return total.select(F.col("n").cast("bigint").alias("pairs"), F.when(~F.isnan(pearson), pearson).alias("pearson"))
