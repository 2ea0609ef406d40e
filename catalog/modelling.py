"""Calibration, transition, classifiers, evaluation, statistics and runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.common import DOCS, LEX, SETTINGS, articles, documents, table
from catalog.features import lexical_ctes
from newslens.functions.scalars import dot
from newslens.operators import calibration as cal
from newslens.operators import evaluate as ev
from newslens.operators import stats
from newslens.operators.classify import fit_classifier
from newslens.operators.features import lexical_features
from newslens.operators.fidelity import distance_correlation
from newslens.operators.transition import fit_centred_transition, fit_transition, transition_table, with_projection
from newslens.plans import sweeps
from newslens.plans import training as tr
from newslens.runtime import materialize, scratch_path, spread

LEXICAL = ("SR", "UL", "SP", "NC", "SQ", "FC")
DIMS = 64  # of the supplied vectors


def _lexical(spark, sf):
    docs = spread(documents(spark, sf).select("doc_id", "text", "lang", "n_chars"), "doc_id")
    return lexical_features(docs, "text", LEX).drop("text")


# ---- calibration and transition -------------------------------------------


def minmax_fit(spark, sf):
    return cal.fit_minmax(_lexical(spark, sf), LEXICAL).select("feature", F.round("lo", 9).alias("lo"), F.round("width", 9).alias("width"))


def minmax_apply(spark, sf):
    df = materialize(_lexical(spark, sf).select("doc_id", *LEXICAL), "lexical")
    scaled = cal.apply_minmax(df, cal.fit_minmax(df.filter("doc_id % 2 = 0"), LEXICAL))
    return scaled.select("doc_id", *[F.round(c, 9).alias(c) for c in LEXICAL])


# Two targets on the vectors: a linear one, which a transition must recover, and the 0/1 class.
def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("A", F.col("embedding").cast("array<double>"))
    ramp = F.array(*[F.lit(float(i)) for i in range(64)])
    return e.select("vec_id", "A", dot(F.col("A"), ramp).alias("linear"), (F.col("label") >= 5).cast("int").alias("label"))


def transition(spark, sf):
    """Two linear targets: weights 0, 1, 2, ... and 1, -1, 1, ... by construction."""
    signs = F.array(*[F.lit(float(1 - 2 * (i % 2))) for i in range(64)])
    df = _vectors(spark, sf).withColumn("alternating", dot(F.col("A"), signs))
    targets = ("linear", "alternating")
    return transition_table(spark, fit_transition(df, "A", targets), targets).select("dim", "feature", (F.round("weight", 4) + F.lit(0.0)).alias("weight"))


def linear_recovery(spark, sf):
    """The linear target comes back from the projection, row by row."""
    df = _vectors(spark, sf)
    t = fit_transition(df, "A", ("linear",))
    return with_projection(df, "A", t, ("linear",)).select("vec_id", F.round("linear_hat", 5).alias("linear"))


def centred_projection(spark, sf):
    """Vectors centred by their mean: the projection is the linear target less its mean."""
    df = _vectors(spark, sf)
    t, mean = fit_centred_transition(df, "A", ("linear",))
    return with_projection(df, "A", t, ("linear",), mean=mean).select("vec_id", (F.round("linear_hat", 4) + F.lit(0.0)).alias("linear"))


# ---- classifiers ----------------------------------------------------------


def classifier(kind):
    def query(spark, sf):
        df = materialize(_vectors(spark, sf).select("vec_id", "label", *[F.col("A")[i].alias(f"x{i}") for i in range(DIMS)]), "vectors")
        names = tuple(f"x{i}" for i in range(DIMS))
        model = fit_classifier(df, names, kind)
        return model.predict(df).select("vec_id", "label", "pred", F.round("score", 6).alias("score"))

    return query


def _stages(spark, sf, settings=SETTINGS):
    return tr.stage_tables(articles(spark, sf), settings, scratch_path(spark, "run"))


def train_step(spark, sf):
    features, splits = _stages(spark, sf)
    prepared = tr.prepare(tr.rows_of_seed(features, splits, 13), SETTINGS)
    model = tr.fit(prepared, SETTINGS, 13)
    weights = spark.createDataFrame(list(zip(model.features, model.weights)), "feature string, weight double")
    return prepared.minmax.join(weights, "feature")


def predictions(spark, sf):
    features, splits = _stages(spark, sf)
    run = tr.fit_and_score(features, splits, SETTINGS, 13)
    return run.scored.filter("split <> 'train'").select("id", "split", "label", "pred", "score")


# ---- evaluation -----------------------------------------------------------


def _rule_scores(spark, sf):
    """A length rule as predictor of quality: many ties, both classes."""
    joined = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return joined.select(
        F.col("quality").alias("label"),
        "lang",
        F.floor(F.col("n_chars") / 100).cast("double").alias("score"),
        (F.col("n_chars") > 1000).cast("int").alias("pred"),
    )


def confusion(spark, sf):
    m = ev.binary_metrics(_rule_scores(spark, sf), by=["lang"])
    return m.select("lang", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def auc(spark, sf):
    return ev.roc_auc(_rule_scores(spark, sf)).select(F.round("auc", 6).alias("auc"))


def auc_by_language(spark, sf):
    return ev.roc_auc(_rule_scores(spark, sf), by=["lang"]).select("lang", F.round("auc", 6).alias("auc"))


def report(spark, sf):
    return ev.classification_report(_rule_scores(spark, sf))


def saved_evaluation(spark, sf):
    folder = scratch_path(spark, "run")
    run = tr.run_training(articles(spark, sf), SETTINGS, 13, folder)
    return tr.evaluate_saved(spark, run.folder, "test")


def fidelity(spark, sf):
    """Distances over all coordinates against the same coordinates cut to one digit."""
    v = table(spark, sf, "embeddings")
    cols = {f"x{i}": F.col("embedding")[i].cast("double") for i in range(DIMS)}
    df = v.select("vec_id", *[c.alias(n) for n, c in cols.items()], *[F.floor(c * 10).alias(f"{n}_hat") for n, c in cols.items()])
    out = distance_correlation(df, list(cols), [f"{n}_hat" for n in cols], "vec_id")
    return out.select("pairs", F.round("pearson", 6).alias("pearson"))


def metrics_rows(spark, sf):
    features, splits = _stages(spark, sf)
    return tr.fit_and_score(features, splits, SETTINGS, 17).metrics


def paired_test(spark, sf):
    t = stats.paired_t_test(_lexical(spark, sf), "SR", "UL", by=["lang"])
    return t.select("lang", "n", F.round("mean_diff", 9).alias("mean_diff"), F.round("t", 5).alias("t"), F.round("p", 6).alias("p"))


def _source_tests(spark, sf):
    """One hypothesis per source: do texts use 'the, of, la, der' as often as 'and, with, et, und'?"""
    docs = spread(documents(spark, sf).select("doc_id", "text", "source"), "doc_id")
    df = lexical_features(docs, "text", LEX).withColumn("half", F.lit(0.65))
    return stats.paired_t_test(df, "SP", "half", by=["source"])


def holm(spark, sf):
    return stats.holm_bonferroni(materialize(_source_tests(spark, sf), "p-values")).select("source", F.round("p", 6).alias("p"), "reject")


def pca(spark, sf):
    df = _vectors(spark, sf).select("vec_id", "label", *[F.col("A")[i].alias(f"x{i}") for i in range(DIMS)])
    return ev.pca_coordinates(df, [f"x{i}" for i in range(DIMS)], ("vec_id", "label"))


# ---- runs -----------------------------------------------------------------


def run_tables(spark, sf):
    folder = scratch_path(spark, "run")
    out = tr.run_training(articles(spark, sf), SETTINGS, 13, folder).folder
    names = ("A", "B", "B_raw", "B_hat", "T", "minmax", "evidence", "predictions", "reports", "fidelity", "metrics", "splits")
    rows = None
    for n in names:
        one = spark.read.parquet(f"{out}/{n}").agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def training_run(spark, sf):
    folder = scratch_path(spark, "run")
    run = tr.run_training(articles(spark, sf), SETTINGS, 13, folder)
    return spark.read.parquet(f"{run.folder}/metrics")


def baselines(spark, sf):
    return sweeps.run_baselines(articles(spark, sf), SETTINGS, scratch_path(spark, "run"))


def ablations(spark, sf):
    return sweeps.run_ablations(articles(spark, sf), SETTINGS, scratch_path(spark, "run"))


def feature_drops(spark, sf):
    return sweeps.run_ablations(
        articles(spark, sf), SETTINGS, scratch_path(spark, "run"), weights=[SETTINGS.weights], drops=sweeps.DROP_GRID
    )


def summary(spark, sf):
    return sweeps.summarize(sweeps.run_baselines(articles(spark, sf), SETTINGS, scratch_path(spark, "run")))


def stage_reuse(spark, sf):
    """Two sweeps over one folder: the second finds both stage tables."""
    folder = scratch_path(spark, "run")
    first = tr.stage_tables(articles(spark, sf), SETTINGS, folder)
    again = tr.stage_tables(articles(spark, sf), replace(SETTINGS, classifier="logreg", drop_features=("PR",)), folder)
    rows = [
        t.agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit(n)).withColumn("reused", F.lit(t.inputFiles() == u.inputFiles()))
        for n, t, u in zip(("features", "splits"), first, again)
    ]
    return rows[0].unionByName(rows[1])


def cross_source(spark, sf):
    """Train on one half of the sources, test on the other."""
    half = F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0, "even").otherwise("odd")
    df = materialize(articles(spark, sf).withColumn("source", half), "halves")
    return sweeps.cross_source(df, SETTINGS, "even", ["odd"], 13)


QUERIES = {
    "m1_minmax_fit": minmax_fit,
    "p8_minmax_apply": minmax_apply,
    "m2_transition": transition,
    "m3_projection": linear_recovery,
    "x8_centred_projection": centred_projection,
    "m4_linear_svm": classifier("linear_svm"),
    "m5_logreg": classifier("logreg"),
    "m6_rbf_svm": classifier("rbf_svm"),
    "m8_train_step": train_step,
    "m9_predictions": predictions,
    "v1_binary_metrics": confusion,
    "v2_roc_auc": auc,
    "v2_roc_auc_by_language": auc_by_language,
    "v3_classification_report": report,
    "v4_saved_evaluation": saved_evaluation,
    "v5_fidelity": fidelity,
    "v6_metrics_rows": metrics_rows,
    "v7_paired_t_test": paired_test,
    "v8_holm": holm,
    "v9_pca": pca,
    "s10_run_tables": run_tables,
    "r1_training_run": training_run,
    "r2_baselines": baselines,
    "r3_ablations": ablations,
    "r4_feature_drops": feature_drops,
    "r5_summary": summary,
    "r8_stage_reuse": stage_reuse,
    "r9_cross_source": cross_source,
}

_LEX = f"{DOCS}, {lexical_ctes()}"
_RULE = """rule AS (SELECT l.quality AS label, d.lang, floor(d.n_chars / 100.0) AS score, (d.n_chars > 1000)::INT AS pred
  FROM documents d JOIN labels l USING (doc_id))"""
_CONF = """count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 0) AS tn,
  count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn"""
_AUC = """round(sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS auc
  FROM rule p JOIN rule q ON p.label = 1 AND q.label = 0"""


def _t_sql(by: str, diff: str) -> str:
    """t per group and its two-sided p by Simpson's rule over the density on [0, |t|]."""
    return f"""sums AS (SELECT {by}, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM (SELECT {by}, {diff} AS d FROM src) GROUP BY {by}),
ts AS (SELECT *, mean_diff / (sd / sqrt(n)) AS t, n - 1 AS df FROM sums),
grid AS (SELECT {by}, df, least(abs(t), 60.0) / 4000 AS h, i FROM ts, range(4001) g(i)),
area AS (SELECT {by}, sum(h / 3 * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0) - 0.5 * ln(df * pi()) - (df + 1) / 2.0 * ln(1 + (i * h) * (i * h) / df))) AS a
  FROM grid GROUP BY {by}),
pv AS (SELECT ts.*, greatest(0.0, 1.0 - 2.0 * a) AS p FROM ts JOIN area USING ({by}))"""


_SAFE = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"

ORACLE = {
    "m1_minmax_fit": f"WITH {_LEX} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(min({c}), 9) AS lo, round(CASE WHEN max({c}) - min({c}) < 1e-9 THEN 1.0 ELSE max({c}) - min({c}) END, 9) AS width FROM lex"
        for c in LEXICAL
    ),
    "p8_minmax_apply": f"""WITH {_LEX}, m AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) - min({c}) AS w_{c}' for c in LEXICAL)}
        FROM lex WHERE doc_id % 2 = 0)
      SELECT doc_id, {', '.join(f'round(({c} - lo_{c}) / CASE WHEN w_{c} < 1e-9 THEN 1.0 ELSE w_{c} END, 9) AS {c}' for c in LEXICAL)} FROM lex, m""",
    "m2_transition": """SELECT (unnest(range(len(any_value(embedding)))))::INT AS dim, 'linear' AS feature,
      unnest(range(len(any_value(embedding))))::DOUBLE AS weight FROM embeddings
      UNION ALL SELECT (unnest(range(len(any_value(embedding)))))::INT, 'alternating',
      1.0 - 2.0 * (unnest(range(len(any_value(embedding)))) % 2) FROM embeddings""",
    "m3_projection": "SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: i * embedding[i + 1]::DOUBLE)), 5) AS linear FROM embeddings",
    "x8_centred_projection": """WITH v AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: i * embedding[i + 1]::DOUBLE)) AS x FROM embeddings)
      SELECT vec_id, round(x - avg(x) OVER (), 4) + 0.0 AS linear FROM v""",
    "v1_binary_metrics": f"""WITH {_RULE}, c AS (SELECT lang, {_CONF} FROM rule GROUP BY lang),
      r AS (SELECT *, (tp + tn)::DOUBLE / greatest(1, tp + tn + fp + fn) AS a, tp::DOUBLE / greatest(1, tp + fp) AS p, tp::DOUBLE / greatest(1, tp + fn) AS r FROM c)
      SELECT lang, tp, tn, fp, fn, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
        round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r""",
    "v2_roc_auc": f"WITH {_RULE} SELECT {_AUC}",
    "v2_roc_auc_by_language": f"""WITH {_RULE}, per AS (SELECT p.lang, {_AUC} AND p.lang = q.lang GROUP BY p.lang)
      SELECT l.lang, coalesce(per.auc, 'nan'::DOUBLE) AS auc FROM (SELECT DISTINCT lang FROM rule) l LEFT JOIN per USING (lang)""",
    "v3_classification_report": f"""WITH {_RULE}, c AS (SELECT {_CONF} FROM rule),
      m AS (SELECT *, tn + fp AS s0, tp + fn AS s1, {_SAFE('tn', 'tn + fn')} AS p0, {_SAFE('tn', 'tn + fp')} AS r0, {_SAFE('2 * tn', '2 * tn + fn + fp')} AS f0,
        {_SAFE('tp', 'tp + fp')} AS p1, {_SAFE('tp', 'tp + fn')} AS r1, {_SAFE('2 * tp', '2 * tp + fp + fn')} AS f1, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS a FROM c)
      SELECT 'fake' AS row, round(p0, 4) AS precision, round(r0, 4) AS recall, round(f0, 4) AS f1, s0 AS support FROM m
      UNION ALL SELECT 'real', round(p1, 4), round(r1, 4), round(f1, 4), s1 FROM m
      UNION ALL SELECT 'accuracy', round(a, 4), round(a, 4), round(a, 4), s0 + s1 FROM m
      UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), s0 + s1 FROM m
      UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 4), round((r0 * s0 + r1 * s1) / (s0 + s1), 4),
        round((f0 * s0 + f1 * s1) / (s0 + s1), 4), s0 + s1 FROM m""",
    "v5_fidelity": """WITH v AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x::DOUBLE) AS b FROM embeddings),
      w AS (SELECT vec_id, b, list_transform(b, lambda x: floor(x * 10)) AS h FROM v)
      SELECT count(*) AS pairs, round(corr(list_distance(x.b, y.b), list_distance(x.h, y.h)), 6) AS pearson
      FROM w x JOIN w y ON x.vec_id < y.vec_id""",
    "v7_paired_t_test": f"""WITH {_LEX}, src AS (SELECT d.lang, SR, UL FROM lex JOIN documents d USING (doc_id)), {_t_sql('lang', 'SR - UL')}
      SELECT lang, n, round(mean_diff, 9) AS mean_diff, round(t, 5) AS t, round(p, 6) AS p FROM pv""",
    "v8_holm": f"""WITH {_LEX}, src AS (SELECT d.source, SP FROM lex JOIN documents d USING (doc_id)), {_t_sql('source', 'SP - 0.65')},
      r AS (SELECT source, p, p <= 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) AS ok, row_number() OVER (ORDER BY p) AS k FROM pv)
      SELECT source, round(p, 6) AS p, bool_and(ok) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS reject FROM r""",
    "s10_run_tables": """WITH n AS (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id))
      SELECT unnest(['A', 'B', 'B_raw', 'B_hat', 'evidence', 'predictions', 'splits']) AS name, n AS rows FROM n
      UNION ALL SELECT * FROM (VALUES ('T', 4096), ('minmax', 8), ('reports', 10), ('fidelity', 1), ('metrics', 2)) t(name, rows)""",
    "r8_stage_reuse": """SELECT unnest(['features', 'splits']) AS stage, unnest([count(*), 7 * count(*)]) AS rows, true AS reused
      FROM documents JOIN labels USING (doc_id)""",
}
