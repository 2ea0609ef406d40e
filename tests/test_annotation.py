"""Clusters, boundary pairs, kappa and the stopping rule against plain NumPy and loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.operators import agreement as ag
from newslens.operators import boundary as bd


def points(spark, rng, n=300, dims=4, groups=6):
    centre = rng.normal(0, 4, (groups, dims))
    rows = [(i, i % 2, (centre[rng.integers(groups)] + rng.normal(0, 1, dims)).tolist()) for i in range(n)]
    odd = [(n, 0, None), (n + 1, 1, [1.0, None, 0.0, 0.0]), (n + 2, 0, [float("nan")] * dims), (n + 3, None, [0.0] * dims), (n + 4, 1, [float("inf")] * dims)]
    return rows, spark.createDataFrame(rows + odd, "id bigint, side int, vector array<double>")


def test_lloyd_from_the_same_seeds(spark):
    rows, df = points(spark, np.random.default_rng(1))
    got, centres = bd.class_clusters(df.repartition(4), k=5, sample=40)
    for side in (0, 1):
        ids = [i for i, s, _ in rows if s == side]
        x = np.array([v for _, s, v in rows if s == side])
        drawn = sorted(range(len(ids)), key=lambda j: hashlib.md5(str(ids[j]).encode()).hexdigest())[:40]
        chosen = [drawn[0]]
        while len(chosen) < 5:
            chosen.append(max(drawn, key=lambda j: min(((x[j] - x[c]) ** 2).sum() for c in chosen)))
        c = x[chosen]
        for _ in range(200):
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(5)])
        assert np.allclose(centres[side], c, atol=1e-9)
        assert {r.id: r.cluster for r in got.filter(f"side = {side}").collect()} == dict(zip(ids, at.tolist()))


def test_clusters_of_nothing_of_one_side_and_of_equal_points(spark):
    empty = spark.createDataFrame([], "id bigint, side int, vector array<double>")
    assert bd.class_clusters(empty)[0].count() == 0
    same = spark.createDataFrame([(i, 1, [1.0, 2.0]) for i in range(9)], empty.schema)
    rows, centres = bd.class_clusters(same, k=4)
    assert {r.cluster for r in rows.collect()} == {0} and list(centres) == [1]


def test_boundary_pairs_equal_all_pairs_with_hot_cluster(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, int(rng.integers(0, 3)) if i < 60 else 0, rng.integers(-6, 7, 3).astype(float).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, side int, cluster int, vector array<double>")
    pairs = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (0, 9)], "p int, q int")
    got = {}
    for r in bd.boundary_pairs(df, pairs, k=4, block=32).collect():
        got.setdefault((r.p, r.q, r.id), {})[r.rank] = (round(r.distance, 9), r.neighbour)
    want = {}
    for p, q in ((0, 0), (1, 0), (2, 2)):
        for i, s, c, v in rows:
            if s == 0 and c == p:
                far = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 9), j) for j, t, d, w in rows if t == 1 and d == q)
                want[p, q, i] = dict(enumerate(far[:4], 1))
    assert got == want


def test_affinity_keeps_the_top_share(spark):
    _, df = points(spark, np.random.default_rng(3))
    rows = bd.usable(df).withColumn("cluster", (F.col("id") % 10 / 2).cast("int"))
    shapes = {(r.side, r.cluster): r for r in bd.cluster_shapes(rows).collect()}
    pairs = bd.cluster_pairs(bd.cluster_shapes(rows), 0.2).collect()
    assert len(pairs) == 25
    plain = {}
    for p in range(5):
        for q in range(5):
            a, b = shapes[0, p], shapes[1, q]
            plain[p, q] = (a.radius + b.radius) / float(np.linalg.norm(np.array(a.centre) - np.array(b.centre)))
    assert all(abs(r.affinity - plain[r.p, r.q]) < 1e-9 for r in pairs)
    best = sorted(plain, key=plain.get, reverse=True)[:5]  # percent ranks 0 to 4/24
    assert {(r.p, r.q) for r in pairs if r.kept} == set(best)


def plain_kappa(pairs, weights):
    n = sum(weights)
    if not n:
        return None
    same = sum(w for (a, b), w in zip(pairs, weights) if a == b) / n
    labels = {x for p in pairs for x in p}
    chance = sum(sum(w for (a, _), w in zip(pairs, weights) if a == c) * sum(w for (_, b), w in zip(pairs, weights) if b == c) for c in labels) / n / n
    return (same - chance) / (1 - chance) if chance < 1 else None


def poisson(replicate, item):
    draw = int(hashlib.md5(f"{replicate // 4}:{item}".encode()).hexdigest()[8 * (replicate % 4) :][:8], 16)
    return sum(draw >= t for t in ag.STEPS)


def test_kappa_and_its_interval(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "xyz"[int(rng.integers(3))], None) for i in range(240)]
    rows = [(i, a, a if rng.random() < 0.7 else "xyz"[int(rng.integers(3))], "p" if i % 3 else None) for i, a, _ in rows]
    rows += [(900, None, "x", "p"), (901, "x", None, "p"), (902, "x", "x", "only one label"), (rows[0])]
    df = spark.createDataFrame(rows, "item bigint, a string, b string, part string")
    got = {r.part: r for r in ag.kappa_bootstrap(df, "item", "a", "b", "part", replicates=30).collect()}
    assert set(got) == {"p", None, "only one label"}
    assert got["only one label"].kappa is None and not got["only one label"].passes and got["only one label"].observed == 1.0
    for part in ("p", None):
        mine = [(i, (a, b)) for i, a, b, p in rows if p == part and a and b]
        pairs = [p for _, p in mine]
        assert got[part].n == len(mine) and got[part].kappa == pytest.approx(plain_kappa(pairs, [1] * len(mine)))
        drawn = [plain_kappa(pairs, [poisson(r, i) for i, _ in mine]) for r in range(30)]
        assert (got[part].low, got[part].high) == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])))
        assert got[part].passes == (got[part].kappa >= 0.8)


def test_weights_are_poisson():
    drawn = np.array([poisson(r, i) for r in range(8) for i in range(4000)])
    assert abs(drawn.mean() - 1) < 0.03 and abs(drawn.var() - 1) < 0.05


@pytest.mark.parametrize("kappas, stop", [([0.1, 0.3, 0.305, 0.31, 0.5], 4), ([0.1, 0.3, 0.305, 0.4, 0.405], None), ([0.2, 0.85, 0.85, 0.85], 2), ([0.5, 0.4, 0.45, 0.44, 0.43], 5), ([None, 0.2, None, 0.2], None), ([], None)])
def test_plateau(spark, kappas, stop):
    df = spark.createDataFrame([(i + 1, k) for i, k in enumerate(kappas)], "round int, kappa double")
    got = ag.plateau(df, ceiling=0.8).collect()
    assert len(got) == len(kappas) and [r["round"] for r in got if r.stop] == ([stop] if stop else [])


def test_rounds_are_halves(spark):
    items = ag.annotation_rounds(spark.range(4000).withColumnRenamed("id", "item"), "item", 4).groupBy("round", "held_out").count().collect()
    assert len(items) == 8 and all(400 < r["count"] < 600 for r in items)


def test_nearest_centre_by_products_equals_differences():
    rng = np.random.default_rng(3)
    centres = np.concatenate([rng.normal(size=(9, 5)), np.zeros((1, 5)), np.full((1, 5), 1e180)])
    centres[4] = centres[2]
    x = np.concatenate([rng.normal(size=(5000, 5)), centres, (centres[:1] + centres[1:2]) / 2, np.full((2, 5), 1e170), rng.normal(size=(50, 5)) + 1e9])
    want = np.concatenate([((x[i : i + 99, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), 99)])
    assert (bd._nearest(x, centres) == want).all()


def test_centres_are_found_from_packed_blocks(spark):
    _, df = points(spark, np.random.default_rng(4))
    packed = bd._packed(bd.usable(df).repartition(3))
    assert {r.side: r.n for r in packed.groupBy("side").agg(F.sum("n").alias("n")).collect()} == {0: 150, 1: 150}
    assert all(len(r.block) == r.n * 4 * 8 for r in packed.collect())
