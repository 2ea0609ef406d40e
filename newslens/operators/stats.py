"""Paired significance test and step-down correction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from newslens.operators.ordering import running_total


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny, key=abs)
    value = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / max(1.0 + num * d, tiny, key=abs)
            c = max(1.0 + num / c, tiny, key=abs)
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p value of Student's t: I_x(df/2, 1/2) at x = df / (df + t^2)."""
    if math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_fraction(x, a, b) / a)
    return max(0.0, 1.0 - front * _beta_fraction(1.0 - x, b, a) / b)


def _p_values(t: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array(
        [None if a is None or b is None else t_two_sided(a, b - 1) for a, b in zip(t.to_pylist(), n.to_pylist())],
        pa.float64(),
    )


def paired_t_test(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean difference, t and two-sided p of ``a - b`` over rows that hold both, per ``by`` group."""

    def p_values(t: pa.Array, n: pa.Array) -> pa.Array:
        return _p_values(t, n)

    diff = F.col(a).cast("double") - F.col(b).cast("double")
    sums = df.select(*by, diff.alias("_d")).filter("_d IS NOT NULL").groupBy(*by).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("_sd")
    )
    t = F.when(
        F.col("_sd") > 0, F.col("mean_diff") / (F.nullif(F.col("_sd"), F.lit(0.0)) / F.sqrt(F.col("n").cast("double")))
    ).when(F.col("mean_diff") == 0, F.lit(float("nan"))).otherwise(F.signum("mean_diff") * float("inf"))
    with_t = sums.withColumn("t", F.when(F.col("n") > 1, t).otherwise(float("nan")))
    return with_t.withColumn("p", F.arrow_udf(p_values, DoubleType())("t", "n")).drop("_sd")


def holm_bonferroni(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Add ``reject`` by Holm's step-down rule: p values in order, stop at the first that fails.

    Among equal p values the first has the strictest threshold, so counting the
    strictly smaller ones decides for all of them; no global window is needed.
    """
    per_value = df.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_m"))
    total = per_value.agg(F.sum("_m")).first()[0] or 0
    ranked = running_total(per_value, "_p", "_m", "_below")
    first_fail = ranked.filter(F.col("_p") > F.lit(alpha) / (F.lit(total) - F.col("_below"))).agg(F.min("_p")).first()[0]
    return df.withColumn("reject", F.lit(True) if first_fail is None else F.col(p) < F.lit(first_fail))
