"""Stage reuse, readers over many files, labels and roles."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.config import FACT_KEYWORDS, RunSettings
from newslens.functions.encoders import hash_encoder, pick_encoder
from newslens.functions.scalars import label_code, standard_label, strict_label_code
from newslens.operators.evidence import keyword_spans, token_spans
from newslens.plans import sweeps
from newslens.plans import training as tr
from newslens.plans.datasets import process_custom
from newslens.runtime import exists
from newslens.sources import readers

ROWS = "id string, title string, text string, label int, source string"
SETTINGS = RunSettings(seeds=(13,), n_splits=1)


def make_small_encoder():
    def small():  # a nested function travels with the job
        return lambda texts: np.full((len(texts), 4), 0.5)

    return small


small_encoder = make_small_encoder()


def corpus(spark, n=40, source="s"):
    rows = [(f"a{i}", f"Title {i}", f"Stone {i} is good. The lake {i * 7} was terrible.", i % 2, source) for i in range(n)]
    return spark.createDataFrame(rows, ROWS)


def test_another_encoder_has_other_tables(spark, tmp_path):
    df, folder = corpus(spark), str(tmp_path)
    assert len(tr.stage_tables(df, SETTINGS, folder)[0].first().A) == 512
    other = replace(SETTINGS, encoder="small")
    assert len(tr.stage_tables(df, other, folder, small_encoder)[0].first().A) == 4
    with pytest.raises(ValueError):
        tr.stage_tables(df, SETTINGS, folder, small_encoder)


def test_digest_sees_every_column_and_doubled_rows(spark):
    df = corpus(spark)
    changed = [df.withColumn("source", F.lit("t")), df.withColumn("title", F.lit(None).cast("string")), df.limit(39)]
    swapped = df.select("id", F.col("text").alias("title"), F.lit(None).cast("string").alias("text"), "label", "source")
    digests = [tr.corpus_digest(x) for x in [df, *changed, swapped]]
    assert len(set(digests)) == len(digests) and tr.corpus_digest(df.repartition(7)) == digests[0]
    with pytest.raises(ValueError, match="unique"):
        tr.corpus_digest(df.union(df.limit(2)))


def test_unfinished_stage_is_built_again(spark, tmp_path):
    path = tmp_path / "stage"
    spark.range(3).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    assert tr.stored(spark, str(tmp_path), "stage", lambda: spark.range(5)).count() == 5
    assert exists(spark, f"{path}/_SUCCESS") and tr.stored(spark, str(tmp_path), "stage", lambda: spark.range(9)).count() == 5


def test_auto_is_decided_before_tasks():
    def broken():
        raise OSError("no model")

    assert pick_encoder("auto", broken) is hash_encoder and pick_encoder("auto", small_encoder) is small_encoder


def test_labels_with_unicode_space(spark):
    df = spark.createDataFrame([(" 1",), (" hoax ",), ("\tfake",), (None,)], "v string")
    got = df.select(standard_label(F.col("v")).alias("s"), F.expr("1").alias("x")).collect()
    assert [r.s for r in got] == ["real", "fake", "fake", None]
    assert df.limit(3).filter("v = '\tfake'").select(strict_label_code(F.col("v")).alias("c")).first().c == 0
    assert df.select(label_code(standard_label(F.col("v"))).alias("c")).first().c == 1


def test_more_files_than_any_limit_in_mixed_order(spark, tmp_path):
    for i in range(70):
        lines = [["text,label", f"t{i},fake"], ["label,text", f"real,t{i}"], ["label,text,more", f"real,t{i},m"]][i % 3]
        (tmp_path / f"f {i}.csv").write_text("\n".join(lines) + "\n")
    rows = readers.read_csv(spark, str(tmp_path), ["*.csv"]).collect()
    assert sorted(r.text for r in rows) == sorted(f"t{i}" for i in range(70))
    assert all(r.label == ("fake" if int(r.text[1:]) % 3 == 0 else "real") for r in rows)
    done = process_custom(spark, str(tmp_path), ["text"], "label", multiline=False)
    assert done.count() == 70


def test_lexicon_with_tabs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("\tGood \n \nbad\n")
    assert {r.word for r in readers.read_lexicon(spark, str(tmp_path / "l.txt")).collect()} == {"good", "bad"}


def test_all_spans_can_be_kept(spark):
    df = spark.createDataFrame([(["good"] * 50, ["good"] + [" good"] * 49)], "w array<string>, s array<string>")
    n = lambda limit: df.select(F.size(token_spans(F.col("w"), F.col("s"), lambda w: w == "good", limit)).alias("n")).first().n
    assert (n(30), n(None)) == (30, 50)
    text = " ".join(FACT_KEYWORDS)
    m = lambda limit: spark.range(1).select(F.size(keyword_spans(F.lit(text), limit)).alias("n")).first().n
    assert m(2) == 2 and m(None) == len(FACT_KEYWORDS)


def test_a_test_source_may_be_called_train(spark):
    df = corpus(spark, 30, "mine").union(corpus(spark, 30, "train").withColumn("id", F.concat(F.lit("t"), "id")))
    got = sweeps.cross_source(df, SETTINGS, "mine", ["train"], 13).collect()
    assert [(r.split, r.n if "n" in r else r.tp + r.fp + r.tn + r.fn) for r in got] == [("train", 30)]
