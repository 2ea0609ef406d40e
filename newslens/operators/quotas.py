"""Exact "first q rows by key" per partition without ranking whole partitions.

Two label values would put half of all rows into one window task. A histogram
over 65,536 hash buckets tells in which bucket a quota ends; all earlier buckets
are taken whole, and only that one bucket is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newslens.functions.hashing import order_bucket
from newslens.operators.ordering import bucket_offsets

LAST_BUCKET = 1 << 16


def take_segments(df: DataFrame, partition: Sequence[str], key: str, quotas: dict[tuple, list[int]]) -> DataFrame:
    """Add ``segment``: 0 up to the first cumulative quota, 1 up to the second, and so on.

    ``key`` is a unique :func:`order_key`. ``quotas`` holds one list per
    partition value, a handful of rows; partitions without quotas are dropped.
    """
    spark = df.sparkSession
    width = len(next(iter(quotas.values())))
    fields = [df.schema[c] for c in partition]
    bucketed = df.withColumn("_bucket", order_bucket(F.col(key)))
    counts = bucketed.groupBy(*partition, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    wanted = spark.createDataFrame(
        [(*p, j, q) for p, qs in quotas.items() for j, q in enumerate(qs)],
        StructType([*fields, StructField("_j", LongType()), StructField("_quota", LongType())]),
    )
    ends = (
        bucket_offsets(counts, "_n", partition)
        .join(F.broadcast(wanted), list(partition))
        .filter((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_n")))
        .collect()
    )
    found = {(*[r[c] for c in partition], r["_j"]): (r["_bucket"], r["_before"]) for r in ends}
    rows = []
    for p, qs in quotas.items():
        row = list(p)
        for j, q in enumerate(qs):
            bucket, before = found.get((*p, j), (LAST_BUCKET if q > 0 else -1, 0))
            row += [bucket, before, q]
        rows.append(tuple(row))
    names = [f"_{n}{j}" for j in range(width) for n in ("cut", "before", "quota")]
    cuts = spark.createDataFrame(rows, StructType([*fields, *[StructField(n, LongType()) for n in names]]))
    tagged = bucketed.join(F.broadcast(cuts), list(partition))
    at_cut = reduce(lambda a, b: a | b, [F.col("_bucket") == F.col(f"_cut{j}") for j in range(width)])
    rank = F.row_number().over(Window.partitionBy(*partition, "_bucket").orderBy(key))
    ranked = tagged.filter(~at_cut).withColumn("_rank", F.lit(0)).unionByName(tagged.filter(at_cut).withColumn("_rank", rank))
    outside = [
        F.when(
            (F.col("_bucket") < F.col(f"_cut{j}"))
            | ((F.col("_bucket") == F.col(f"_cut{j}")) & (F.col(f"_before{j}") + F.col("_rank") <= F.col(f"_quota{j}"))),
            0,
        ).otherwise(1)
        for j in range(width)
    ]
    return ranked.withColumn("segment", reduce(lambda a, b: a + b, outside)).drop("_bucket", "_rank", *names)
