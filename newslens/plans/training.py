"""Feature tables, training, evaluation and the tables a run leaves behind."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.config import FEATURE_ORDER, RunSettings
from newslens.functions import text as tx
from newslens.functions.encoders import Encoder, hash_encoder
from newslens.operators.calibration import apply_minmax, fit_minmax
from newslens.operators.classify import Classifier, fit_classifier
from newslens.operators.embedding import with_document_vectors
from newslens.operators.evaluate import binary_metrics, classification_report, roc_auc
from newslens.operators.evidence import with_evidence
from newslens.operators.features import lexical_features
from newslens.operators.fidelity import distance_correlation
from newslens.operators.lexicon_tables import UNUSUAL, read_verdicts, table_features
from newslens.operators.report import report_records
from newslens.operators.splits import article_groups, select_split, stratified_splits
from newslens.operators.transition import fit_centred_transition, fit_transition, transition_table, with_projection
from newslens.runtime import exists, materialize, spread
from newslens.sources.writers import write_splits, write_tables

FEATURE_FIELDS = ("weights", "max_body_sentences", "lexicons", "lexicon_table", "fact_confirmation", "encoder", "max_token_spans", "max_keyword_spans")
RUN_KEYS = ("seed", "kind", "run", "split")
TRAIN = "split = 'train'"
SPLIT_FIELDS = ("seeds", "n_splits", "ratio", "dedupe", "max_bits")


def article_features(
    articles: DataFrame,
    settings: RunSettings,
    encoder: Callable[[], Encoder] = hash_encoder,
    evidence: bool = False,
    others: Sequence[tuple[float, float, float]] = (),
) -> DataFrame:
    """Articles with A and all feature columns and, if wanted, the evidence behind them, and ``A0, A1, ...`` for ``others``, further weights.

    One narrow pass over the text: no shuffle whatever the size. With ``settings.lexicon_table`` the words of the texts
    are joined with that table first.
    """
    base = spread(articles, "id")
    table_size = None
    if settings.lexicon_table:
        verdicts = read_verdicts(articles.sparkSession, settings.lexicon_table)
        table_size = verdicts.filter(F.col("bits").bitwiseAND(UNUSUAL) > 0).count() if evidence else None
        lexical = table_features(base, verdicts, "id", "text", settings.fact_confirmation, keep_parts=True)
    else:
        lexical = lexical_features(base, "text", settings.lexicons, settings.fact_confirmation, keep_parts=True)
    out = with_document_vectors(
        lexical.withColumn("_lead", tx.lead(F.col("_sents"))),
        "title",
        "_lead",
        "_sents",
        encoder=encoder,
        weights=settings.weights,
        max_body_sentences=settings.max_body_sentences,
        others=others,
    )
    names = FEATURE_ORDER + (("FC",) if settings.fact_confirmation else ())
    if evidence:
        out = with_evidence(
            out,
            "text",
            settings.lexicons,
            settings.fact_confirmation,
            max_token_spans=settings.max_token_spans,
            max_keyword_spans=settings.max_keyword_spans,
            table_size=table_size,
        )
    more = [f"A{k}" for k in range(len(others))]
    return out.select("id", "label", "source", "A", *names, *(["evidence"] if evidence else []), *more)


def article_evidence(articles: DataFrame, settings: RunSettings, encoder: Callable[[], Encoder] = hash_encoder) -> DataFrame:
    """``(id, features)``: value, spans, notes and details of every feature."""
    full = article_features(articles, settings, encoder, evidence=True)
    return full.select("id", F.col("evidence").alias("features"))


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table by name: read when it was written to its end, otherwise built and written once."""
    path = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def corpus_digest(articles: DataFrame) -> str:
    """Row count and order-free content hash, so a stage table is never reused for other rows.

    Every column a stage table depends on counts, and where it is NULL; the sum (unlike an xor) also sees
    doubled rows. Ids must be unique, because groups and splits are joined by them.
    """
    columns = ("id", "title", "text", "label", "source")
    content = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]).cast("decimal(38,0)")
    per_id = articles.select("id", content.alias("_content")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("_content").alias("total"))
    wrong = F.when((F.col("n") > 1) | F.col("id").isNull(), F.struct("n", "id"))
    n, total, doubled = per_id.agg(F.sum("n"), F.sum("total"), F.max(wrong)).first()
    if doubled:
        raise ValueError(f"ids must be unique and not null: {doubled.id!r} has {doubled.n} rows")
    return f"{n or 0}-{int(total or 0) % 2**64:016x}"


def stage_tables(
    articles: DataFrame,
    settings: RunSettings,
    folder: str,
    encoder: Callable[[], Encoder] = hash_encoder,
    corpus: str | None = None,
    weights: Sequence[tuple[float, float, float]] = (),
) -> tuple[DataFrame, DataFrame]:
    """Features and splits, addressed by the rows and the settings they depend on.

    Sweeps over classifiers or dropped features find both tables again, and give the digest of the
    ``corpus`` so that the rows are read for it only once. Sweeps over ``weights`` name them all: only A depends on them, so
    one pass over the texts serves the feature tables of all that are missing. ``settings.encoder`` names the encoder.
    """
    if encoder is not hash_encoder and settings.encoder == "hash":
        raise ValueError("settings.encoder must name the encoder")
    spark = articles.sparkSession
    corpus = corpus or corpus_digest(articles)

    def name(one: RunSettings) -> str:
        return f"features-{one.encoder}-{corpus}-{one.digest(*FEATURE_FIELDS)}"

    def build_features() -> DataFrame:
        known = {settings.weights: settings} | {tuple(w): replace(settings, weights=tuple(w)) for w in weights}
        del known[settings.weights]
        missing = {w: s for w, s in known.items() if not exists(spark, f"{folder.rstrip('/')}/{name(s)}/_SUCCESS")}
        rows = article_features(articles, settings, encoder, evidence=True, others=tuple(missing))
        if not missing:
            return rows
        columns = rows.columns[: len(rows.columns) - len(missing)]
        rows = materialize(rows, "features-of-weights")
        for k, s in enumerate(missing.values()):
            stored(spark, folder, name(s), lambda: rows.select(*[F.col(f"A{k}").alias("A") if c == "A" else c for c in columns]))
        return rows.select(*columns)

    features = stored(spark, folder, name(settings), build_features)

    def build_splits() -> DataFrame:
        groups = article_groups(articles, settings.dedupe, settings.max_bits)
        return stratified_splits(articles, settings.seeds, settings.n_splits, settings.ratio, groups=groups)

    return features, stored(spark, folder, f"splits-{corpus}-{settings.digest(*SPLIT_FIELDS)}", build_splits)


@dataclass(frozen=True)
class Prepared:
    """Rows of one seed with calibrated features, and what the training rows gave."""

    rows: DataFrame
    minmax: DataFrame
    T: np.ndarray | None
    features: tuple[str, ...]
    train: str
    mean: np.ndarray | None = None

    @property
    def train_rows(self) -> DataFrame:
        return self.rows.filter(self.train)


def prepare(rows: DataFrame, settings: RunSettings, transition: bool = True, train: str = TRAIN) -> Prepared:
    """Calibrate on the training rows (those for which ``train`` holds), then fit the transition on them."""
    features = settings.features
    params = fit_minmax(rows.filter(train), features)
    scaled = materialize(apply_minmax(rows, params), "run-rows")
    t = mean = None
    if transition and settings.centre:
        t, mean = fit_centred_transition(scaled.filter(train), "A", features, settings.svd_tolerance)
    elif transition:
        t = fit_transition(scaled.filter(train), "A", features, settings.svd_tolerance)
    return Prepared(scaled, params, t, features, train, mean)


def rows_of_seed(features: DataFrame, splits: DataFrame, seed: int) -> DataFrame:
    return features.drop("evidence").join(select_split(splits, seed).select("id", "split"), "id")


def fit(prepared: Prepared, settings: RunSettings, seed: int) -> Classifier:
    return fit_classifier(
        prepared.train_rows, prepared.features, settings.classifier, settings.C, settings.gamma, seed=seed
    )


def metrics_table(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts, ratios and AUC for every ``by`` value (a few runs and splits)."""
    auc = roc_auc(scored, by=by)
    return binary_metrics(scored, by=by).join(F.broadcast(auc), list(by))


def evaluation_rows(scored: DataFrame, settings: RunSettings, seed: int, train: str = TRAIN) -> DataFrame:
    """Scored rows that were not trained on, marked with the run they belong to."""
    marks = {"seed": F.lit(seed), "kind": F.lit(settings.classifier), "run": F.lit(settings.digest())}
    return scored.filter(f"not ({train})").withColumns(marks).select(*RUN_KEYS, "id", "label", "pred", "score")


@dataclass(frozen=True)
class Run:
    """Fitted parts, scored rows and metrics of one seed."""

    prepared: Prepared
    classifier: Classifier
    scored: DataFrame
    metrics: DataFrame
    folder: str | None = None


def fit_and_score(features: DataFrame, splits: DataFrame, settings: RunSettings, seed: int) -> Run:
    prepared = prepare(rows_of_seed(features, splits, seed), settings)
    model = fit(prepared, settings, seed)
    scored = materialize(model.predict(with_projection(prepared.rows, "A", prepared.T, prepared.features, mean=prepared.mean)), "scored")
    return Run(prepared, model, scored, metrics_table(evaluation_rows(scored, settings, seed), RUN_KEYS))


def run_training(
    articles: DataFrame, settings: RunSettings, seed: int, folder: str, encoder: Callable[[], Encoder] = hash_encoder
) -> Run:
    """Train and evaluate one seed and save every table of the run in ``Run.folder``, below ``folder``.

    ``articles`` holds id, title, text, label (0/1) and source. The run's folder is named by rows, settings and seed.
    """
    spark = articles.sparkSession
    corpus = corpus_digest(articles)
    features, splits = stage_tables(articles, settings, folder, encoder, corpus)
    run = fit_and_score(features, splits, settings, seed)
    names = run.prepared.features
    hats = [f"{n}_hat" for n in names]
    val = run.scored.filter("split = 'val'")
    out = f"{folder.rstrip('/')}/run-{corpus}-{settings.digest()}-{seed}"
    reports = [
        classification_report(run.scored.filter(F.col("split") == s)).withColumn("split", F.lit(s)) for s in ("val", "test")
    ]
    mean = run.prepared.mean
    centre = {} if mean is None else {"A_mean": spark.createDataFrame(list(enumerate(mean.tolist())), "dim int, mean double")}
    write_tables(
        {
            **centre,
            "A": run.scored.select("id", "A"),
            "B": run.scored.select("id", *names),
            "B_raw": features.select("id", *names),
            "B_hat": run.scored.select("id", *hats),
            "T": transition_table(spark, run.prepared.T, names),
            "minmax": run.prepared.minmax,
            "evidence": features.select("id", F.col("evidence").alias("features")),
            "predictions": run.scored.select("id", "label", "split", "score", "pred"),
            "reports": reports[0].unionByName(reports[1]),
            "fidelity": distance_correlation(val, names, hats),
            "metrics": run.metrics,
        },
        out,
    )
    write_splits(select_split(splits, seed), f"{out}/splits")
    run.classifier.save(f"{out}/classifier")
    return replace(run, folder=out)


def run_report(run: Run, articles: DataFrame, settings: RunSettings) -> DataFrame:
    """Report record of every row of a finished run; provenance names its settings, encoder, classifier and seed."""
    facts = {"settings": settings.digest(), "encoder": settings.encoder, "classifier": run.classifier.kind, "seed": run.classifier.seed}
    evidence = articles.sparkSession.read.parquet(f"{run.folder}/evidence")
    return report_records(run.scored, evidence, articles, run.classifier, facts)


def evaluate_saved(spark: SparkSession, run_folder: str, split: str = "test") -> DataFrame:
    """Score a saved run again on val or test; the one-row result is saved next to it."""
    if split not in ("val", "test"):
        raise ValueError(f"unknown split: {split}")
    model = Classifier.load(f"{run_folder}/classifier")
    labels = spark.read.parquet(f"{run_folder}/predictions").filter(F.col("split") == split).select("id", "label")
    scored = materialize(model.predict(spark.read.parquet(f"{run_folder}/B").join(labels, "id")), "evaluated")
    measured = metrics_table(scored.withColumn("split", F.lit(split)), ["split"])
    result = measured.select("split", "accuracy", "precision", "recall", "f1", "auc")
    result.write.mode("overwrite").json(f"{run_folder}/eval_{split}")
    return result
