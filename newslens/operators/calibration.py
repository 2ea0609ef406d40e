"""Min-max calibration on training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WIDTH = 1e-9


def fit_minmax(train: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """``(feature, lo, width)``, one row per feature; a constant feature gets width 1."""
    ends = train.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])
    rows = []
    for c in features:
        lo, span = F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")
        width = F.when(span < MIN_WIDTH, 1.0).otherwise(span)
        rows.append(F.struct(F.lit(c).alias("feature"), lo.alias("lo"), width.alias("width")))
    return ends.select(F.inline(F.array(*rows)))


def apply_minmax(df: DataFrame, params: DataFrame) -> DataFrame:
    """Scale feature columns in place, without clipping. The parameters are one row per feature."""
    scale = {r.feature: (r.lo, r.width) for r in params.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(lo)) / F.lit(width) for c, (lo, width) in scale.items()})
