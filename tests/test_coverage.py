"""Greedy coverage and densities against plain loops."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.operators import coverage as cv


def plain(rows, budget):
    """Every step scores every item that is left."""
    left = [r for r in rows if r[0] is not None and r[1] is not None and r[1] >= 0]
    counts, out = [Counter() for _ in rows[0][2:]], []
    while left and len(out) < budget:
        gain = lambda r: r[1] * (sum(1.0 / (1.0 + c[v]) for c, v in zip(counts, r[2:])) / len(counts))
        best = min(left, key=lambda r: (-gain(r), r[0]))
        out.append((len(out) + 1, best[0], best[1], gain(best)))
        left.remove(best)
        for c, v in zip(counts, best[2:]):
            c[v] += 1
    return out


def items(n, seed, levels=None):
    rng = np.random.default_rng(seed)
    # a third of all rows share one source; coarse priorities tie
    return [
        (i, float(rng.integers(levels)) / levels if levels else float(rng.random()), "hot" if i % 3 == 0 else f"s{rng.integers(12)}", None if i % 7 == 0 else "abc"[rng.integers(3)])
        for i in range(n)
    ]


SCHEMA = "id bigint, p double, source string, topic string"


@pytest.mark.parametrize("levels, pool", [(None, None), (5, None), (None, 3), (5, 3), (1, 7)])
def test_greedy_equals_plain_loop(spark, levels, pool):
    rows = items(260, 3, levels) + [(900, None, "x", "a"), (None, 1.0, "x", "a"), (901, float("nan"), "x", "a"), (902, -1.0, "x", "a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in cv.greedy_coverage(df, "id", "p", ["source", "topic"], 40, pool).orderBy("step").collect()]
    assert got == plain(rows, 40)


def test_default_budget(spark):
    rows = items(1500, 4)
    got = cv.greedy_coverage(spark.createDataFrame(rows, SCHEMA), "id", "p", ["source", "topic"]).orderBy("step").collect()
    assert [tuple(r) for r in got] == plain(rows, 200)
    shares = Counter(rows[r.id][2] for r in got)
    assert shares["hot"] < 0.2 * 200  # a third of the rows, not of the picks


def test_few_items_no_items_and_no_facets(spark):
    rows = items(5, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert cv.greedy_coverage(df, "id", "p", ["source"], 50).count() == 5
    assert cv.greedy_coverage(df.limit(0), "id", "p", ["source"], 50).count() == 0
    got = cv.greedy_coverage(df, "id", "p", [], 3).orderBy("step").collect()
    assert [r.id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:3]]


def test_density_and_uncertainty(spark):
    rows = items(300, 6)
    df = cv.cell_density(spark.createDataFrame(rows, SCHEMA), ["source", "topic"]).withColumn("u", cv.uncertainty(F.col("p")))
    cells = Counter(r[2:] for r in rows)
    for r in df.collect():
        assert r.density == pytest.approx(cells[r.source, r.topic] / max(cells.values()))
        assert r.u == pytest.approx(1 - abs(2 * r.p - 1))
    assert df.count() == 300
