"""Rank correlation of distances and shared neighbours against plain NumPy."""

import numpy as np
import pandas as pd
import pytest

from newslens.operators import structure as st

SCHEMA = "id bigint, query boolean, a array<double>, b array<double>"


def rows(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(-4, 5, (n, 3)).astype(float)
    a[:copies] = a[0]
    b = a[:, :2] + rng.integers(-1, 2, (n, 2))
    b[:copies] = b[0]
    return [(i * 3, i % 5 == 0, a[i].tolist(), b[i].tolist()) for i in range(n)]


def plain(data, k):
    pairs, nears = [], {}
    for i, ask, a, b in data:
        if ask:
            d = [(j, np.sqrt(((np.array(a) - c) ** 2).sum()), np.sqrt(((np.array(b) - e) ** 2).sum())) for j, _, c, e in data if j != i]
            pairs += [(x, y) for _, x, y in d]
            first, second = ({j for _, j in sorted((p[at], p[0]) for p in d)[:k]} for at in (1, 2))
            nears[i] = (len(first), len(first & second))
    x, y = (pd.Series(c).rank() for c in zip(*pairs))
    return len(pairs), np.corrcoef(x, y)[0, 1], nears


@pytest.mark.parametrize("copies", [0, 70])
def test_blocks_equal_all_pairs(spark, copies):
    data = rows(150, 1, copies)
    bad = [(1, True, None, [0.0, 0.0]), (2, True, [0.0, None, 0.0], [0.0, 0.0]), (4, False, [0.0] * 3, [float("nan"), 0.0]), (None, True, [0.0] * 3, [0.0] * 2)]
    df = spark.createDataFrame(data + bad, SCHEMA).repartition(3)
    pairs = st.query_distances(df, 4, query_block=7, block=20)
    n, rho, nears = plain(data, 4)
    got = st.rank_correlation(pairs).first()
    assert got.pairs == n and got.spearman == pytest.approx(rho, abs=1e-12)
    assert {r["query"]: (r.n, r.overlap) for r in st.neighbour_overlap(pairs, 4).collect()} == nears


def test_one_row_of_measures(spark):
    data = rows(60, 2)
    n, rho, nears = plain(data, 10)
    got = st.structure_kept(spark.createDataFrame(data, SCHEMA)).first()
    assert (got.pairs, got.queries) == (n, len(nears)) and got.spearman == pytest.approx(rho, abs=1e-12)
    assert got.preservation == pytest.approx(np.mean([o / k for k, o in nears.values()]))


def test_same_space_few_rows_and_nothing(spark):
    same = spark.createDataFrame([(i, True, [float(i * i)], [float(i * i)]) for i in range(4)], SCHEMA)
    got = st.structure_kept(same).first()
    assert (got.pairs, got.queries, got.preservation) == (12, 4, 1.0) and got.spearman == pytest.approx(1.0)
    none = st.structure_kept(same.limit(0)).first()
    assert (none.pairs, none.queries, none.spearman, none.preservation) == (0, 0, None, None)
    alone = st.structure_kept(same.limit(1)).first()
    assert (alone.pairs, alone.queries) == (0, 0)
    equal = st.structure_kept(spark.createDataFrame([(i, True, [1.0], [2.0]) for i in range(3)], SCHEMA)).first()
    assert equal.spearman is None and equal.preservation == 1.0


@pytest.mark.parametrize("copies", [0, 60])
def test_many_distances_are_ranked_by_bins_and_not_stored(spark, monkeypatch, copies):
    """Continuous vectors take the bins, with copies as bin 0; distances that crowd into few bins are ranked one by one."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 5))
    a[:copies] = a[0]
    b = a[:, :3] + 0.4 * rng.normal(size=(400, 3)) * (np.arange(400) >= copies)[:, None]
    data = [(i, i % 9 == 0, a[i].tolist(), b[i].tolist()) for i in range(400)]
    n, rho, nears = plain(data, 10)
    for name, value in (("EXACT_PAIRS", 0), ("MANY_QUERIES", 11), ("MANY_ROWS", 70), ("STEP_ROWS", 33), ("TALLY", 500), ("MAX_SHARE", 0.01)):
        monkeypatch.setattr(st, name, value)
    real, calls = st.query_distances, []
    monkeypatch.setattr(st, "query_distances", lambda *args: calls.append(1) or real(*args))
    got = st.structure_kept(spark.createDataFrame(data, SCHEMA).repartition(3)).first()
    assert (got.pairs, got.queries, len(calls)) == (n, len(nears), 0)
    assert got.spearman == pytest.approx(rho, abs=1e-6)
    assert got.preservation == pytest.approx(np.mean([o / m for m, o in nears.values()]))
    grid = rows(150, 3)
    n, rho, nears = plain(grid, 10)
    got = st.structure_kept(spark.createDataFrame(grid, SCHEMA)).first()
    assert (got.pairs, len(calls)) == (n, 1) and got.spearman == pytest.approx(rho, abs=1e-12)
