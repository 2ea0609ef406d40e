"""The neighbour graph and its search against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import nn_descent as nn

SCHEMA = "vec_id bigint, embedding array<float>, code string"


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 24)), rng.normal(size=(1, 24)) + 0.05 * rng.normal(size=(300, 24))]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 150, axis=0), x[5:6]])  # a vector that 151 rows share, a pair
    return np.arange(len(x)) * 5, x


def test_recall_and_exact_scores(spark, table):
    ids, x = table
    rows = [(int(i), [float(c) for c in v], "x") for i, v in zip(ids, x)]
    nan, inf = float("nan"), float("inf")
    odd = [(7, None, "x"), (11, [0.0] * 24, "x"), (12, [nan] * 24, "x"), (100_000, [inf] * 24, "x"), (13, [None] + [1.0] * 23, "x"), (14, [1.0], "x"), (None, [1.0] * 24, "x"), rows[3]]
    vectors = spark.createDataFrame(rows + odd, SCHEMA)
    got = {}
    for r in nn.nearest(vectors, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [i for i in ids.tolist() if i % 100 == 0]
    assert sorted(got) == queries
    y, hits = x.astype(np.float64), 0
    for q in queries:
        found = sorted(got[q])
        want = brute(ids, y, q // 5)
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in [v for _, v, _ in found]
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        for _, v, s in found:
            assert s == pytest.approx(np.sqrt(((y[q // 5] - y[v // 5]) ** 2).sum()), abs=1e-12)
        hits += len({v for _, v, _ in found} & {v for v, _ in want})
    assert hits / (10 * len(queries)) >= 0.95
    # the shared vector: all ten at distance 0, smallest ids first
    assert [v for _, v, s in sorted(got[0]) if s == 0] == [v for v, _ in brute(ids, y, 0)]


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, [1.0, 0.5], "x")]
    got = nn.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(2, 0.5), (1, round(2**0.5, 6))]
    assert nn.nearest(spark.createDataFrame(rows[:1], SCHEMA), F.col("id") == 0).count() == 0
    assert nn.nearest(spark.createDataFrame([], SCHEMA), F.col("id") == 0).count() == 0
    assert nn.nearest(spark.createDataFrame([(0, None, "x")], SCHEMA), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("kind, spread", [("float", 1e-4), ("double", 1e-9)])
def test_near_copies_closer_than_a_code_step(spark, kind, spread):
    """3,000 unequal near copies, far nearer to each other than 1/127 of their components, beside 2,000 other vectors."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1, 8)) + spread * rng.normal(size=(3000, 8)), rng.normal(size=(2000, 8))])
    x = x.astype(np.float32).astype(np.float64) if kind == "float" else x
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(4)
    got = {}
    for r in nn.nearest(vectors, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {v for v, _ in brute(np.arange(len(x)), x, q)}) for q in range(0, len(x), 100)]
    assert sum(hits[:30]) / 300 >= 0.95 and sum(hits[30:]) / 200 >= 0.95
