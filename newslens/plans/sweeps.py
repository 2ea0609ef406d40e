"""Sweeps over classifiers, seeds, weights and features, and their summary."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.config import RunSettings
from newslens.functions.encoders import Encoder, hash_encoder
from newslens.operators.classify import KINDS
from newslens.plans.training import (
    RUN_KEYS,
    article_features,
    corpus_digest,
    evaluation_rows,
    fit,
    metrics_table,
    prepare,
    rows_of_seed,
    stage_tables,
)
from newslens.runtime import materialize

# The documented ablation grid.
WEIGHT_GRID = ((0.1, 0.3, 0.6), (0.2, 0.3, 0.5), (0.3, 0.2, 0.5))
DROP_GRID = ((), ("PR",), ("SR",), ("HS",), ("UL",), ("SP", "NC"))


def _sweep(features: DataFrame, splits: DataFrame, settings: RunSettings, seed: int, kinds: Sequence[str]) -> list[DataFrame]:
    """Scored val and test rows of several classifiers on one seed; calibration is shared. None of them reads A."""
    prepared = prepare(rows_of_seed(features.drop("A"), splits, seed), settings, transition=False)
    scored = []
    for kind in kinds:
        one = replace(settings, classifier=kind)
        scored.append(evaluation_rows(fit(prepared, one, seed).predict(prepared.rows), one, seed))
    return scored


def run_baselines(
    articles: DataFrame,
    settings: RunSettings,
    folder: str,
    kinds: Sequence[str] = KINDS,
    encoder: Callable[[], Encoder] = hash_encoder,
) -> DataFrame:
    """Every classifier on every split seed. Features and splits are computed once."""
    features, splits = stage_tables(articles, settings, folder, encoder)
    scored = []
    for seed in settings.seeds[: settings.n_splits]:
        scored += _sweep(features, splits, settings, seed, kinds)
    return metrics_table(materialize(reduce(DataFrame.unionByName, scored), "baselines"), RUN_KEYS)


def run_ablations(
    articles: DataFrame,
    settings: RunSettings,
    folder: str,
    kinds: Sequence[str] = KINDS,
    weights: Iterable[tuple[float, float, float]] = WEIGHT_GRID,
    drops: Iterable[tuple[str, ...]] = ((),),
    encoder: Callable[[], Encoder] = hash_encoder,
) -> DataFrame:
    """Grid of classifier x embedding weights x dropped features on the first seed.

    Weights change the feature table, so they are the outer loop; the other two
    reuse it. One pass over the texts makes the tables of all weights.
    """
    seed, scored, corpus = settings.seeds[0], [], corpus_digest(articles)
    weights = [tuple(w) for w in weights]
    for w in weights:
        weighted = replace(settings, weights=w)
        features, splits = stage_tables(articles, weighted, folder, encoder, corpus, weights)
        for drop in drops:
            marks = {"weights": F.lit("/".join(map(str, w))), "dropped": F.lit("+".join(drop))}
            one = replace(weighted, drop_features=tuple(drop))
            scored += [s.withColumns(marks) for s in _sweep(features, splits, one, seed, kinds)]
    rows = materialize(reduce(DataFrame.unionByName, scored), "ablations")
    return metrics_table(rows, ("weights", "dropped", *RUN_KEYS))


def summarize(metrics: DataFrame, by: Sequence[str] = ("kind", "split")) -> DataFrame:
    """Mean and standard deviation of every metric over the seeds."""
    names = ("accuracy", "precision", "recall", "f1", "auc")
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        *[f(m).alias(f"{m}_{n}") for m in names for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
    )


def cross_source(
    articles: DataFrame,
    settings: RunSettings,
    train_on: str,
    test_on: Sequence[str],
    seed: int,
    encoder: Callable[[], Encoder] = hash_encoder,
) -> DataFrame:
    """Train on one source and test on others, whole sources each, whatever they are called."""
    wanted = articles.filter(F.col("source").isin(train_on, *test_on))
    features = article_features(wanted, settings, encoder).withColumn("split", F.col("source"))
    rows = materialize(features.withColumn("trained", F.col("source") == train_on), "xgen")
    prepared = prepare(rows, settings, transition=False, train="trained")
    scored = evaluation_rows(fit(prepared, settings, seed).predict(prepared.rows), settings, seed, "trained")
    return metrics_table(materialize(scored, "xgen-scored"), RUN_KEYS).withColumn("trained_on", F.lit(train_on))
