"""Combining, balancing and profiling standard datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions import text as tx
from newslens.functions.hashing import order_key
from newslens.operators.quotas import take_segments


def combine(datasets: list[DataFrame]) -> DataFrame:
    """Bag union by column name; ids are left as they are."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), datasets)


def balance(df: DataFrame, id_col: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """As many fake as real rows; rows with other labels are left out.

    A row's place is the md5 of (seed, id), so the choice depends on neither
    partitioning nor input order.
    """
    pair = df.filter(F.col(label).isin("fake", "real"))
    counts = {r[0]: r[1] for r in pair.groupBy(label).count().collect()}
    size = min(counts.get("fake", 0), counts.get("real", 0))
    keyed = pair.withColumn("_key", order_key(F.lit(seed), F.col(id_col)))
    chosen = take_segments(keyed, [label], "_key", {("fake",): [size], ("real",): [size]})
    return chosen.filter("segment = 0").drop("segment", "_key")


def statistics(df: DataFrame) -> DataFrame:
    """Totals, means and the label and source histograms as ``(metric, key, value)``."""
    has_title = F.count(F.when(F.length("title") > 0, 1)) if "title" in df.columns else F.lit(0)
    squeezed = tx.squeeze(F.col("text"))
    totals = df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg(F.length("text")).alias("avg_text_length"),
        F.avg(F.size(tx.words(squeezed))).alias("avg_word_count"),
        has_title.alias("has_title"),
    )
    names = totals.columns
    long = totals.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")
    ).select("m.*")

    def histogram(column: str, metric: str) -> DataFrame:
        counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key")).count()
        return counts.select(F.lit(metric).alias("metric"), "key", F.col("count").cast("double").alias("value"))

    out = long.unionByName(histogram("label", "label_distribution"))
    return out.unionByName(histogram("source", "source_distribution")) if "source" in df.columns else out
