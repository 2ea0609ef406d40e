"""Which items experts review next: priority from uncertainty and density, spread over facets under a budget."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.runtime import materialize

BUDGET = 200
PICK = "step int, id {kind}, priority double, gain double"


def uncertainty(probability: Column) -> Column:
    """1 where a classifier is undecided, 0 where it is sure."""
    return F.lit(1.0) - F.abs(F.lit(2.0) * probability - F.lit(1.0))


def cell_density(items: DataFrame, cell: Sequence[str], out: str = "density") -> DataFrame:
    """Share of the fullest cell that each row's own cell holds; nulls are a value.

    Counts are summed before the shuffle; the table of cells joins back by a hash of the cell, and Spark broadcasts it
    only while it is small.
    """
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in cell])
    counts = materialize(items.groupBy(key.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")), "cells")
    most = counts.agg(F.max("_n")).first()[0] or 1
    dense = counts.select("_cell", (F.col("_n") / F.lit(float(most))).alias(out))
    return items.withColumn("_cell", key).join(dense, "_cell").drop("_cell")


def _weight(counts: Sequence) -> Column | float:
    """Mean over the facets of 1 / (1 + picks that share the facet's value), for columns as for numbers."""
    return sum(1.0 / (1.0 + n) for n in counts) / float(len(counts))


def greedy_coverage(items: DataFrame, item: str, priority: str, facets: Sequence[str], budget: int = BUDGET, pool: int | None = None) -> DataFrame:
    """``(step, id, priority, gain)`` of ``budget`` items, picked one by one by the largest gain; ties to the smaller id.

    The gain of an item is its priority times the mean over ``facets`` of 1 / (1 + picks so far with the same value), so a
    topic, source or time that was picked often loses weight. This is the exact greedy order over all items: gains only fall, so
    of the ``pool`` best by current gain (4 budgets by default) the next pick is certain as long as it comes before the last of
    the pool; then Spark scores all items again. A pass returns ``pool`` rows to the driver and joins at most ``budget``
    values a facet; no pass depends on how many items share a value.

    Items need unique ids. Null facets are a value of their own. Items with a null id, or a null, NaN or negative priority,
    take no part; fewer items than the budget are all picked.
    """
    spark, pool = items.sparkSession, max(1, pool or 4 * budget)
    names = [f"_f{i}" for i in range(len(facets))]
    values = [F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("")).alias(n) for f, n in zip(facets, names)]
    rows = items.select(F.col(item).alias("_id"), F.col(priority).cast("double").alias("_p"), *values)
    rows = materialize(rows.filter(F.col("_id").isNotNull() & ~F.isnan("_p") & (F.col("_p") >= 0)), "coverage")
    picked: list[tuple] = []
    counts = [Counter() for _ in facets]
    while len(picked) < budget:
        scored = rows
        for name, seen in zip(names, counts):
            table = spark.createDataFrame([(v, float(n)) for v, n in seen.items()], f"{name} string, {name}_n double")
            scored = scored.join(F.broadcast(table), name, "left").fillna(0.0, [f"{name}_n"])
        if picked:
            done = spark.createDataFrame([(p[1],) for p in picked], rows.select("_id").schema)
            scored = scored.join(F.broadcast(done), "_id", "left_anti")
        weight = _weight([F.col(f"{n}_n") for n in names]) if facets else F.lit(1.0)
        best = scored.withColumn("_g", F.col("_p") * weight).orderBy(F.desc("_g"), "_id").limit(pool + 1).collect()
        if not best:
            break
        more = len(best) > pool
        left, last = best[:pool], (-best[min(pool, len(best)) - 1]["_g"], best[min(pool, len(best)) - 1]["_id"])
        while left and len(picked) < budget:
            now = [(-(r["_p"] * (_weight([float(c[r[n]]) for n, c in zip(names, counts)]) if facets else 1.0)), r["_id"]) for r in left]
            at = min(range(len(left)), key=now.__getitem__)
            if more and now[at] > last:
                break
            row = left.pop(at)
            picked.append((len(picked) + 1, row["_id"], row["_p"], -now[at][0]))
            for n, c in zip(names, counts):
                c[row[n]] += 1
    kind = rows.schema["_id"].dataType.simpleString()
    return spark.createDataFrame(picked, PICK.format(kind=kind))
