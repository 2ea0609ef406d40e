"""Report records against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from newslens.config import Lexicons, RunSettings
from newslens.operators import report as rp
from newslens.operators.classify import Classifier
from newslens.plans import training as tr

TEXTS = [
    (1, "A good day, says Reuters, and a bad night. Truly good!"),
    (2, "Nothing to see."),
    (3, ""),
    (4, None),
    (5, "According to the Associated Press: hoax!  A   massive 🙂 hoax, a fake."),
]


def test_merge_and_marks_equal_plain(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab 🙂é") for _ in range(rng.randrange(0, 30)))
        spans = sorted((s, min(len(text), s + rng.randrange(0, 6))) for s in (rng.randrange(0, len(text) + 1) for _ in range(rng.randrange(0, 6))))
        rows.append((i, text, [{"start": s, "end": e} for s, e in rng.sample(spans, len(spans))]))
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int>>").withColumn("m", rp.merged_spans(F.col("spans")))
    for r in df.withColumn("out", rp.highlighted(F.col("text"), F.col("m"))).collect():
        merged = []
        for s, e in sorted((x.start, x.end) for x in r.spans if x.end > x.start):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want, at = "", 0
        for s, e in merged:
            want, at = want + r.text[at:s] + "[[" + r.text[s:e] + "]]", e
        assert r.out == want + r.text[at:] and [list(x) for x in r.m] == merged


def test_records(spark):
    df = spark.createDataFrame([(i, "Title", t, 0, "s") for i, t in TEXTS], "id int, title string, text string, label int, source string")
    settings = RunSettings(lexicons=Lexicons())
    features = tr.article_features(df, settings, evidence=True)
    model = Classifier("linear_svm", ("SR", "UL", "FC"), (2.0, -3.0, 0.5), 0.25)
    evidence = features.select("id", F.col("evidence").alias("features"))
    got = {r.id: r for r in rp.report_records(features, evidence, df, model, {"run": "x"}).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for r in got.values():
        used = [f for f in r.features if f.contribution is not None]
        assert [f.name for f in used] == ["SR", "UL", "FC"] and len(r.features) == 8
        assert sum(f.contribution for f in used) + r.decision.intercept == pytest.approx(r.decision.margin, abs=1e-12)
        assert r.decision.pred == int(r.decision.margin > 0) and r.provenance == {"run": "x"}
        assert r.annotated.replace("[[", "").replace("]]", "") == (dict(TEXTS)[r.id] or "")
    assert got[1].annotated == "A [[good]] day, says Reuters, and a [[bad]] night. [[Truly]] [[good!]]"
    assert got[1].sources == ["reuters"] and "associated press" in got[5].sources and got[4].annotated == ""
    assert "[[massive]] 🙂 [[hoax,]]" in got[5].annotated


def test_kernel_model_has_no_contributions(spark):
    with pytest.raises(ValueError, match="linear"):
        rp.contributions(Classifier("rbf_svm", ("SR",), (1.0,), 0.0))
