"""Global order without a global window: buckets first, ranks inside buckets."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens.runtime import by_shuffle, materialize


def range_buckets(df: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """Add ``_bucket``: the range of ``key`` a row falls in, ascending.

    The bounds are approximate quantiles found in one pass and then literals,
    so a re-run task puts every row into the same bucket again. Buckets may
    differ in size; the order across them is exact.
    """
    shares = [i / buckets for i in range(1, buckets)]
    (bounds,) = df.agg(F.percentile_approx(key, shares, 10_000).alias("b")).first()
    splits = [-inf, *sorted({float(b) for b in bounds or [0.0]}), inf]
    cut = Bucketizer(splits=splits, inputCol="_key_double", outputCol="_bucket", handleInvalid="keep")
    return cut.transform(df.withColumn("_key_double", F.col(key).cast("double"))).drop("_key_double")


def bucket_offsets(totals: DataFrame, value: str, partition: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` over all earlier buckets. One row per bucket, so the window is small."""
    w = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def running_total(
    df: DataFrame, key: str, value: str, out: str, partition: Sequence[str] = (), buckets: int = 1024
) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``key``; ``key`` must be unique (per partition).

    Work is split over the buckets; only one number per bucket and partition
    value (a few categories, not a key) is broadcast.
    """
    groups = [*partition, "_bucket"]
    bucketed = range_buckets(df, key, buckets)
    totals = bucketed.groupBy(*groups).agg(F.sum(value).alias("_sum"))
    offsets = bucket_offsets(totals, "_sum", partition).select(*groups, "_before")
    inside = Window.partitionBy(*groups).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(F.broadcast(offsets), groups)
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_bucket", "_before")
    )


def dense_index(df: DataFrame, out: str, order_by: str | None = None) -> DataFrame:
    """Number rows 0..n-1.

    With ``order_by`` (a unique numeric column) the numbers follow that order.
    Without it they follow the scan order of the input files; the rows are then
    written once, because only stored rows keep their position when a task is
    run again.
    """
    if order_by is not None:
        return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), order_by, "_one", out).drop("_one")
    stored = materialize(df.withColumn("_pos", F.monotonically_increasing_id()), "scan-order")
    part = F.shiftright("_pos", 33)
    sizes = stored.groupBy(part.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = bucket_offsets(sizes, "_rows").select("_bucket", "_before")
    # one row per scan task: bounded by the task count of the job
    return (
        stored.withColumn("_bucket", part)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_before") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_bucket", "_before", "_pos")
    )


# A key is worth splitting off when it owns more than 1/1000 of all rows (so at
# most 1000 keys are) and more rows than one task handles with ease.
HOT_SHARE = 1000
MIN_HOT_ROWS = 100_000


def attach(
    left: DataFrame,
    right: DataFrame,
    key: str,
    columns: Sequence[str],
    weight: str,
    total: int,
    spread_by: Sequence[str],
) -> DataFrame:
    """Left join with a table of unique keys when some keys own many left rows.

    ``weight`` is the column of ``right`` that tells how many left rows a key
    owns, ``total`` their sum. The few hot keys are broadcast, and their left
    rows are spread by ``spread_by`` instead of meeting in one task; all other
    keys go through an ordinary shuffle join.
    """
    kept = [F.col(c) for c in left.columns]
    hot_above = max(total // HOT_SHARE, MIN_HOT_ROWS)
    if total <= hot_above:
        return left.join(by_shuffle(right.select(key, *columns)), key, "left").select(*kept, *columns)
    hot = F.col(weight) > hot_above
    payload = F.struct(*columns)
    hot_side = right.filter(hot).select(F.col(key).alias("_hk"), payload.alias("_hot"))
    cold_side = right.filter(~hot).select(F.col(key).alias("_ck"), F.lit(0).cast("bigint").alias("_cs"), payload.alias("_cold"))
    marked = left.join(F.broadcast(hot_side), F.col(key) == F.col("_hk"), "left")
    slot = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(*spread_by), F.lit(1 << 20)))
    joined = marked.withColumn("_slot", slot.cast("bigint")).join(
        by_shuffle(cold_side), (F.col(key) == F.col("_ck")) & (F.col("_slot") == F.col("_cs")), "left"
    )
    picked = [F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in columns]
    return joined.select(*kept, *picked)
