"""Agreement of two raters: Cohen's kappa with a bootstrap interval, and the stopping rule over annotation rounds.

The bootstrap draws no copies: replicate r gives every item a Poisson(1) weight read off md5(r, id), so weights are the same on
any cluster. Weighted counts per (part, replicate, label pair) are summed before the shuffle; everything after that has
as many rows as there are label pairs.
"""

from __future__ import annotations

from math import ceil, exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPLICATES = 200
GATE = 0.8
EPSILON = 0.01
# ``weight`` is the number of these that a draw from 0 .. 2^32 - 1 reaches
STEPS = [ceil(sum(exp(-1) / factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]


def keyed_draw(key: Column, chunk: Column | int = 0) -> Column:
    """32 bits of md5(key) as a number; one digest holds four of them."""
    return F.conv(F.substring(F.md5(key), F.lit(1) + F.lit(8) * chunk, F.lit(8)), 16, 10).cast("bigint")


def counted_pairs(ratings: DataFrame, item: str, a: str, b: str, part: str, replicates: int) -> DataFrame:
    """``(part, replicate, a, b, w)``; replicate -1 is the sample itself. Items with a null rating are left out."""
    rows = ratings.select(F.col(part).alias("part"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(item).cast("string").alias("item"))
    rows = rows.filter("a is not null and b is not null")
    group = ["part", "replicate", "a", "b"]
    once = rows.groupBy("part", F.lit(-1).alias("replicate"), "a", "b").agg(F.count(F.lit(1)).alias("w"))
    drawn = rows.filter("item is not null").withColumn("four", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    key = F.concat_ws(":", F.col("four").cast("string"), "item")
    draws = F.array(*[F.struct((F.col("four") * 4 + k).alias("replicate"), keyed_draw(key, k).alias("draw")) for k in range(4)])
    drawn = drawn.select("part", "a", "b", F.explode(draws).alias("x")).select("part", "a", "b", "x.*").filter(F.col("replicate") < replicates)
    weight = sum(((F.col("draw") >= t).cast("bigint") for t in STEPS), F.lit(0).cast("bigint"))
    return once.unionByName(drawn.groupBy(*group).agg(F.sum(weight).alias("w")))


def kappas(counts: DataFrame) -> DataFrame:
    """``(part, replicate, n, observed, expected, kappa)`` from ``(part, replicate, a, b, w)``; kappa is null where chance alone agrees."""
    group = ["part", "replicate"]
    sides = F.array(F.struct(F.col("a").alias("label"), F.col("w").alias("wa"), F.lit(0).cast("bigint").alias("wb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("wa"), F.col("w").alias("wb")))
    margins = counts.select(*group, F.explode(sides).alias("m")).groupBy(*group, "m.label").agg(F.sum("m.wa").alias("wa"), F.sum("m.wb").alias("wb"))
    chance = margins.groupBy(*group).agg(F.sum(F.col("wa").cast("double") * F.col("wb")).alias("chance"))
    same = counts.groupBy(*group).agg(F.sum("w").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("same"))
    both = same.filter("n > 0").join(chance, (same["part"].eqNullSafe(chance["part"])) & (same["replicate"] == chance["replicate"]))
    rated = both.select(same["part"], same["replicate"], "n", (F.col("same") / F.col("n")).alias("observed"), (F.col("chance") / F.col("n") / F.col("n")).alias("expected"))
    return rated.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def kappa_bootstrap(ratings: DataFrame, item: str, a: str, b: str, part: str, replicates: int = REPLICATES, confidence: float = 0.95, gate: float = GATE) -> DataFrame:
    """``(part, n, observed, expected, kappa, low, high, passes)``: kappa per part with the percentile interval of its replicates."""
    every = kappas(counted_pairs(ratings, item, a, b, part, replicates))
    tail = (1 - confidence) / 2
    low, high = (F.percentile(F.when(F.col("replicate") >= 0, F.col("kappa")), q).alias(c) for q, c in ((tail, "low"), (1 - tail, "high")))
    itself = F.col("replicate") == -1
    measures = [F.max(F.when(itself, F.col(c))).alias(c) for c in ("n", "observed", "expected", "kappa")]
    return every.groupBy("part").agg(*measures, low, high).filter("n is not null").withColumn("passes", F.coalesce(F.col("kappa") >= gate, F.lit(False)))


def annotation_rounds(items: DataFrame, item: str, rounds: int) -> DataFrame:
    """``items`` with ``round`` (from 1) and ``held_out``: half of each round evaluates, the other half trains, by md5 of the id."""
    key = F.col(item).cast("string")
    return items.withColumn("round", (keyed_draw(key, 0) % rounds + 1).cast("int")).withColumn("held_out", keyed_draw(key, 1) % 2 == 0)


def plateau(rounds: DataFrame, ceiling: float, epsilon: float = EPSILON, patience: int = 2) -> DataFrame:
    """``(round, kappa, gain, flat, stop)`` from ``(round, kappa)``, one row per round.

    A round is flat if it gains less than ``epsilon`` over the round before; the first round that reaches ``ceiling`` or ends
    ``patience`` flat ones in a row stops. The table has a row per annotation round, so one task orders it.
    """
    order = Window.orderBy("round")
    gained = rounds.withColumn("gain", F.col("kappa") - F.lag("kappa").over(order)).withColumn("flat", F.coalesce(F.col("gain") < epsilon, F.lit(False)))
    run = F.sum(F.col("flat").cast("int")).over(order.rowsBetween(1 - patience, 0)) == patience
    ends = gained.withColumn("ends", F.coalesce(run | (F.col("kappa") >= ceiling), F.lit(False)))
    first = F.min(F.when(F.col("ends"), F.col("round"))).over(Window.partitionBy())
    return ends.select("round", "kappa", "gain", "flat", F.coalesce(F.col("round") == first, F.lit(False)).alias("stop"))
