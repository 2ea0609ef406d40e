import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.config import Lexicons, RunSettings
from newslens.operators import calibration as cal
from newslens.operators import evaluate as ev
from newslens.operators import fidelity, stats
from newslens.operators.classify import Classifier, fit_classifier
from newslens.operators.ordering import running_total
from newslens.operators.transition import fit_centred_transition, fit_transition, with_projection
from newslens.plans import sweeps
from newslens.plans import training as tr

SAMPLE = [
    ("The harbour office published its yearly count. It lists every boat by name and owner.", 1),
    ("Nobody dares to print it, but the moon bridge was sold twice; share before it vanishes!", 0),
    ("Two engineers signed the inspection and the town kept a copy.", 1),
    ("A miracle soup ends all hunger, says a man who would not give his name.", 0),
    ("The library reports good visitor numbers for a third spring.", 1),
    ("They hide the truth about the lake, and only this page tells you.", 0),
    ("The council warned of bad ice and named three streets.", 1),
    ("Shocking trick, shocking trick, every doctor hates the shocking trick.", 0),
    ("The maker lists weight, price and the tests it ran.", 1),
    ("The plant is terrible and awful, whispers say, and nobody checked.", 0),
]


def vectors(spark, a, b, names):
    rows = [([float(v) for v in x], *[float(v) for v in y]) for x, y in zip(a, b)]
    return spark.createDataFrame(rows, "A array<double>, " + ", ".join(f"{n} double" for n in names))


def test_transition_recovers(spark):
    rng = np.random.default_rng(0)
    a, t = rng.normal(size=(50, 16)), rng.normal(size=(16, 5))
    names = [f"b{i}" for i in range(5)]
    df = vectors(spark, a, a @ t, names).repartition(6)
    got = fit_transition(df, "A", names)
    assert np.linalg.norm(a @ got - a @ t) / np.linalg.norm(a @ t) < 1e-9
    hat = with_projection(df, "A", got, names).select(F.max(F.abs(F.col("b3") - F.col("b3_hat")))).first()[0]
    assert hat < 1e-9


@pytest.mark.parametrize("rows, rank", [(40, 3), (5, 5)])
def test_transition_without_full_rank(spark, rows, rank):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(rows, rank)) @ rng.normal(size=(rank, 8)), rng.normal(size=(rows, 2))
    got = fit_transition(vectors(spark, a, b, ["x", "y"]), "A", ["x", "y"])
    assert np.allclose(got, np.linalg.pinv(a, rcond=1e-8) @ b, atol=1e-8)


@pytest.mark.parametrize("rows, rank", [(60, 8), (40, 3), (5, 5), (1, 1)])
def test_centred_transition_equals_centring_first(spark, rows, rank):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(rows, rank)) @ rng.normal(size=(rank, 8)) + 5.0, rng.normal(size=(rows, 2)) + 1.0
    df = vectors(spark, a, b, ["x", "y"]).repartition(5)
    got, mean = fit_centred_transition(df, "A", ["x", "y"])
    centred = a - a.mean(axis=0)
    assert np.allclose(mean, a.mean(axis=0), atol=1e-9)
    assert np.allclose(got, np.linalg.pinv(centred, rcond=1e-8) @ b if rows > 1 else 0.0, atol=1e-9)
    hats = with_projection(df, "A", got, ["x", "y"], mean=mean).select("A", "x_hat", "y_hat").collect()
    assert all(np.allclose([r.x_hat, r.y_hat], (np.array(r.A) - a.mean(axis=0)) @ got, atol=1e-9) for r in hats)


def test_centred_transition_of_equal_vectors_is_zero(spark):
    df = vectors(spark, [[0.1, 0.7, 3.0]] * 7, [[float(i)] for i in range(7)], ["x"]).repartition(3)
    got, mean = fit_centred_transition(df, "A", ["x"])
    assert not got.any() and np.allclose(mean, [0.1, 0.7, 3.0])


def test_transition_errors(spark):
    with pytest.raises(ValueError):
        fit_transition(spark.createDataFrame([], "A array<double>, x double"), "A", ["x"])
    with pytest.raises(Exception, match="one length"):
        fit_transition(spark.createDataFrame([([1.0], 1.0), ([1.0, 2.0], 1.0)], "A array<double>, x double").coalesce(1), "A", ["x"])


def test_minmax(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0)], "a double, c double")
    params = cal.fit_minmax(df, ("a", "c"))
    assert {r.feature: (r.lo, r.width) for r in params.collect()} == {"a": (0.0, 2.0), "c": (5.0, 1.0)}
    out = cal.apply_minmax(spark.createDataFrame([(3.0, 5.0)], "a double, c double"), params).first()
    assert (out.a, out.c) == (1.5, 0.0)


def test_binary_metrics(spark):
    perfect = spark.createDataFrame([(y, y) for y in (0, 1, 1, 0, 1)], "label int, pred int")
    m = ev.binary_metrics(perfect).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (1.0, 1.0, 1.0, 1.0)
    m = ev.binary_metrics(perfect.withColumn("pred", F.lit(0))).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.4, 0.0, 0.0, 0.0)
    rows = {r.row: r for r in ev.classification_report(perfect).collect()}
    assert rows["fake"].support == 2 and rows["macro avg"].f1 == 1.0


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 8))) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert ev.roc_auc(df).first().auc == pytest.approx(want)
    assert math.isnan(ev.roc_auc(df.filter("label = 1")).first().auc)


def test_running_total(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    got = {r.k: r.t for r in running_total(df, "k", "v", "t").collect()}
    assert got == {k: sum(i % 3 for i in range(k)) for k in range(500)}


def test_linear_svm_minimises_its_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 * rng.normal(size=200) > 0.2).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, label int")
    m = fit_classifier(df, ("a", "b", "c"), "linear_svm", C=1.0)
    w, xs, s = np.array([*m.weights, m.intercept]), np.c_[x, np.ones(200)], 2 * y - 1

    def loss(w):
        return w @ w / 2 + (np.maximum(0, 1 - s * (xs @ w)) ** 2).sum()

    best = loss(w)
    assert all(loss(w + d) >= best for d in rng.normal(scale=1e-3, size=(50, 4)))
    acc = ev.binary_metrics(m.predict(df)).first().accuracy
    assert acc > 0.9
    assert ev.binary_metrics(fit_classifier(df, ("a", "b", "c"), "logreg").predict(df)).first().accuracy > 0.9


def test_rbf_svm_separates_a_ring(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, size=(400, 2))
    y = ((x**2).sum(axis=1) < 0.5).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, label int")
    model = fit_classifier(df, ("a", "b"), "rbf_svm", C=10.0, gamma=2.0)
    assert ev.binary_metrics(model.predict(df)).first().accuracy > 0.95
    model.save(f"{tmp_path}/m")
    assert Classifier.load(f"{tmp_path}/m") == model
    with pytest.raises(ValueError):
        fit_classifier(df, ("a", "b"), "forest")


def test_fidelity_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    b = rng.normal(size=(90, 3))
    h = b + 0.5 * rng.normal(size=(90, 3))
    rows = [(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(b, h))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, ah double, bh double, ch double")
    pairs = [(np.linalg.norm(b[i] - b[j]), np.linalg.norm(h[i] - h[j])) for i in range(90) for j in range(i)]
    want = np.corrcoef(np.array(pairs).T)[0, 1]
    for block in (2048, 13):
        monkeypatch.setattr(fidelity, "BLOCK", block)
        got = fidelity.distance_correlation(df, ["a", "b", "c"], ["ah", "bh", "ch"]).first()
        assert got.pairs == len(pairs) and got.pearson == pytest.approx(want)


def test_pca(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) * [5, 2, 1, 0.5]
    df = spark.createDataFrame([(i, i % 2, *map(float, r)) for i, r in enumerate(x)], "id int, label int, a double, b double, c double, d double")
    got = np.array([(r.pc1, r.pc2) for r in ev.pca_coordinates(df, ["a", "b", "c", "d"]).orderBy("id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2]), atol=1e-8)


def test_t_and_p(spark):
    # reference values of Student's t: P(|T| > 2.228139) = 0.05 at 10 degrees of freedom
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_two_sided(0.0, 5) == 1.0
    assert stats.t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 2.5), (4.0, 2.0), (None, 1.0)], "a double, b double")
    r = stats.paired_t_test(df, "a", "b").first()
    d = np.array([0.5, 1.0, 0.5, 2.0])
    assert r.n == 4 and r.t == pytest.approx(d.mean() / (d.std(ddof=1) / 2))


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p double")
    assert [r.reject for r in stats.holm_bonferroni(df).orderBy("i").collect()] == [True, False, False]
    ties = spark.createDataFrame([(0, 0.02), (1, 0.02), (2, 0.001)], "i int, p double")
    assert [r.reject for r in stats.holm_bonferroni(ties).orderBy("i").collect()] == [True, True, True]


def sample_articles(spark):
    rows = [(str(i), "A title", f"{t} Number {i} of the sample follows.", y, "even" if i % 2 else "odd") for i, (t, y) in enumerate(SAMPLE * 3)]
    return spark.createDataFrame(rows, "id string, title string, text string, label int, source string")


def test_run_leaves_all_tables(spark, tmp_path):
    settings = RunSettings(seeds=(13,), n_splits=1, max_bits=0, lexicons=Lexicons())
    run = tr.run_training(sample_articles(spark), settings, 13, str(tmp_path))
    out = run.folder
    for name in ("A", "B", "B_raw", "B_hat", "T", "minmax", "evidence", "predictions", "reports", "fidelity", "metrics", "splits"):
        assert spark.read.parquet(f"{out}/{name}").count() > 0
    again = tr.evaluate_saved(spark, out, "test").first()
    first = run.metrics.filter("split = 'test'").first()
    assert again.accuracy == first.accuracy and (again.auc == first.auc or math.isnan(again.auc))


def test_centred_run_and_its_report(spark, tmp_path):
    settings = RunSettings(seeds=(13,), n_splits=1, max_bits=0, lexicons=Lexicons(), centre=True)
    articles = sample_articles(spark)
    run = tr.run_training(articles, settings, 13, str(tmp_path))
    kept = [r.mean for r in spark.read.parquet(f"{run.folder}/A_mean").orderBy("dim").collect()]
    train = np.array([r.A for r in run.scored.filter("split = 'train'").select("A").collect()])
    assert np.allclose(kept, train.mean(axis=0), atol=1e-9)
    margins = {r.id: r.score for r in run.scored.select("id", "score").collect()}
    records = tr.run_report(run, articles, settings).collect()
    assert {r.id for r in records} == set(margins)
    for r in records:
        total = sum(f.contribution for f in r.features if f.contribution is not None) + r.decision.intercept
        assert abs(total - margins[r.id]) < 1e-9 and r.provenance["classifier"] == "linear_svm"


def test_stage_tables_follow_rows_and_settings(spark, tmp_path):
    settings = RunSettings(seeds=(13,), n_splits=1, dedupe=False)
    df = sample_articles(spark)
    one = tr.stage_tables(df, settings, str(tmp_path))[0].inputFiles()
    assert tr.stage_tables(df.repartition(3), settings, str(tmp_path))[0].inputFiles() == one
    assert tr.stage_tables(df.limit(20), settings, str(tmp_path))[0].inputFiles() != one


def test_sweep_rows(spark, tmp_path):
    settings = RunSettings(seeds=(13, 17), n_splits=2, dedupe=False)
    table = sweeps.run_baselines(sample_articles(spark), settings, str(tmp_path), ("linear_svm", "logreg"))
    assert table.count() == 8
    assert {(r.kind, r.split): r.runs for r in sweeps.summarize(table).collect()} == {
        (k, s): 2 for k in ("linear_svm", "logreg") for s in ("val", "test")
    }


def test_fidelity_in_full_blocks_far_from_the_origin(spark, monkeypatch):
    """Few full blocks, distances in strips, copies, and an offset that plain sums of squares would not survive."""
    monkeypatch.setattr(fidelity, "BLOCK", 10)
    monkeypatch.setattr(fidelity, "FULL_BLOCKS", 3)
    monkeypatch.setattr(fidelity, "STEP", 4)
    monkeypatch.setattr(fidelity, "WIDTH", 7)
    rng = np.random.default_rng(8)
    b = rng.normal(size=(100, 2)) + 1e7
    b[:30] = b[0]
    h = b + 0.3 * rng.normal(size=b.shape)
    rows = [(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(b, h))]
    df = spark.createDataFrame(rows, "id int, a double, b double, ah double, bh double")
    pairs = [(np.linalg.norm(b[i] - b[j]), np.linalg.norm(h[i] - h[j])) for i in range(100) for j in range(i)]
    got = fidelity.distance_correlation(df, ["a", "b"], ["ah", "bh"]).first()
    assert got.pairs == len(pairs) and got.pearson == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-9)
    gap = df.withColumn("ah", F.when(F.col("id") != 3, F.col("ah")))
    got = fidelity.distance_correlation(gap, ["a", "b"], ["ah", "bh"]).first()
    assert (got.pairs, got.pearson) == (len(pairs), None)


def test_one_pass_makes_the_tables_of_all_weights(spark, tmp_path, monkeypatch):
    df, passes = sample_articles(spark), []
    real = tr.article_features
    monkeypatch.setattr(tr, "article_features", lambda *a, **k: passes.append(1) or real(*a, **k))
    grid = [(0.1, 0.3, 0.6), (0.2, 0.3, 0.5), (0.3, 0.2, 0.5)]
    for w in grid:
        got = tr.stage_tables(df, RunSettings(weights=w), str(tmp_path), weights=grid)[0]
        want = real(df, RunSettings(weights=w), evidence=True)
        assert got.columns == want.columns
        assert got.orderBy("id").collect() == want.orderBy("id").collect()
    assert len(passes) == 1
