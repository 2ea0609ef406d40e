"""Leakage-free stratified train/val/test splits over near-duplicate groups."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.config import SPLIT_RATIO
from newslens.functions import text as tx
from newslens.functions.hashing import order_key
from newslens.operators.neardup import near_duplicate_groups
from newslens.operators.ordering import attach
from newslens.operators.quotas import take_segments
from newslens.runtime import by_shuffle, materialize

SPLITS = ("test", "val", "train")


def article_groups(articles: DataFrame, dedupe: bool = True, max_bits: int = 3, id_col: str = "id", text: str = "text") -> DataFrame:
    """``(id, group_id)``; with ``dedupe`` off every row is its own group."""
    if not dedupe:
        return articles.select(F.col(id_col).alias("id"), F.col(id_col).alias("group_id"))
    return near_duplicate_groups(articles, id_col, text, max_bits)


def group_labels(members: DataFrame) -> DataFrame:
    """Majority label per group from ``(group_id, label)``; a tie counts as 0."""
    return members.groupBy("group_id").agg(
        F.when(F.avg("label") > 0.5, 1).otherwise(0).alias("label"), F.count(F.lit(1)).alias("n")
    )


def class_shares(counts: dict[int, int], draws: int) -> dict[int, int]:
    """Proportional integer shares by largest remainder; equal remainders favour the smaller label."""
    total = sum(counts.values())
    exact = {c: Fraction(n * draws, total) for c, n in counts.items()}
    shares = {c: int(x) for c, x in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (shares[c] - exact[c], c))
    for c in by_remainder[: draws - sum(shares.values())]:
        shares[c] += 1
    return shares


def split_quotas(counts: dict[int, int], ratio: tuple[float, float, float] = SPLIT_RATIO) -> dict[int, tuple[int, int]]:
    """Per class how many groups go to test and to val. Sizes are rounded up, test first."""
    n = sum(counts.values())
    n_test = ceil(ratio[2] * n)
    kept = class_shares(counts, n - n_test)
    inner_share = 1 - ratio[0] / (ratio[0] + ratio[1])
    n_val = ceil(inner_share * (n - n_test))
    train = class_shares(kept, n - n_test - n_val) if n > n_test else kept
    return {c: (counts[c] - kept[c], kept[c] - train[c]) for c in counts}


def stratified_splits(
    articles: DataFrame,
    seeds: tuple[int, ...],
    n_splits: int | None = None,
    ratio: tuple[float, float, float] = SPLIT_RATIO,
    dedupe: bool = True,
    max_bits: int = 3,
    groups: DataFrame | None = None,
) -> DataFrame:
    """``(seed, id, group_id, split)`` for the first ``n_splits`` seeds.

    Groups are ordered by md5 of (seed, group_id) inside their class, so a
    split is the same on any cluster and under any partitioning. All rows of a
    group share its split.
    """
    n_splits = len(seeds) if n_splits is None else n_splits
    if len(seeds) < n_splits:
        raise ValueError(f"{n_splits} splits need at least as many seeds, got {len(seeds)}")
    used = [int(s) for s in seeds[:n_splits]]
    if groups is None:
        groups = article_groups(articles, dedupe, max_bits)
    members = materialize(articles.select("id", "label").join(by_shuffle(groups), "id"), "members")
    labels = materialize(group_labels(members), "group-labels")
    counts = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    if not counts:
        return members.select(F.lit(None).cast("int").alias("seed"), "id", "group_id", F.lit(None).cast("string").alias("split"))
    quotas = split_quotas(counts, ratio)
    cumulative = {(s, c): [t, t + v] for s in used for c, (t, v) in quotas.items()}
    keyed = labels.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in used]))).withColumn(
        "_key", order_key(F.col("seed"), F.col("group_id"))
    )
    segments = take_segments(keyed, ["seed", "label"], "_key", cumulative)
    named = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("segment") + 1)
    # at most n_splits entries per group
    per_group = materialize(
        segments.groupBy("group_id").agg(F.collect_list(F.struct("seed", named.alias("split"))).alias("plan"), F.first("n").alias("n")),
        "group-splits",
    )
    assigned = attach(members.select("id", "group_id"), per_group, "group_id", ["plan"], "n", members.count(), ["id"])
    return assigned.select("id", "group_id", F.inline("plan")).select("seed", "id", "group_id", "split")


def select_split(splits: DataFrame, seed: int) -> DataFrame:
    """The split of one seed; the partition filter prunes a stored table. Unknown seeds are an error."""
    chosen = splits.filter(F.col("seed") == seed)
    if chosen.isEmpty():
        raise ValueError(f"no split stored for seed {seed}")
    return chosen


def split_profile(splits: DataFrame, articles: DataFrame) -> DataFrame:
    """Per (seed, split): rows, percent fake, median tokens and sentences (medians cut to integers).

    A split that received no row is listed with zeros.
    """
    squeezed = tx.squeeze(F.coalesce("text", F.lit("")))
    shape = articles.select(
        "id",
        "label",
        F.size(tx.words(squeezed)).alias("tokens"),
        F.size(tx.pieces(tx.mark_sentences(squeezed), "\n")).alias("sentences"),
    )
    measured = (
        splits.join(shape, "id")
        .groupBy("seed", "split")
        .agg(
            F.count(F.lit(1)).alias("n_articles"),
            F.bround(F.avg(F.when(F.col("label") == 0, 100.0).otherwise(0.0)), 2).alias("pct_fake"),
            F.percentile("tokens", 0.5).cast("int").alias("median_tokens"),
            F.percentile("sentences", 0.5).cast("int").alias("median_sentences"),
        )
    )
    frame = splits.select("seed").distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS])))
    return frame.join(measured, ["seed", "split"], "left").na.fill(0)
