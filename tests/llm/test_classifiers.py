"""Language codes and toxicity: held-out accuracy on the supplied rows, and defined edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"
WORDS = {"xx": "kala mako sira pona", "yy": "brug stern vlok dring", "zz": "eiou aeui ouae iaeu"}


def test_codewords_differ():
    for n in (2, 3, 5, 9, 40):
        code = language_id.codewords(n)
        apart = (code[:, None] != code[None]).sum(axis=2) + np.eye(n) * 99
        assert apart.min() >= (1 if n == 2 else 2) and (np.abs(code.sum(axis=0)) < n).all()


def test_language_held_out(spark):
    got = language_id.op1_query(spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.join(lang, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got.count() == 1000 and right > 0.98
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(w.split() * 4)), k) for k, w in WORDS.items() for i in range(30)]
    return language_id.train(spark.createDataFrame(rows, "id bigint, text string, lang string"))


def test_language_edges(spark, model):
    texts = [None, "", "  12 !?", "kala sira", "brug " * 300_000, "STERN Vlok", "kala sira"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, Score string")
    rows = language_id.predict(docs, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "xx", "yy", "yy", "xx"]
    assert [r.score for r in rows[:3]] == [0, 0, 0] and rows[3].score == rows[6].score
    assert language_id.predict(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_is_learned_from_what_is_given(spark):
    none = spark.createDataFrame([], "id bigint, text string, lang string")
    assert language_id.train(none) is None
    one = spark.createDataFrame([(1, "kala mako", "xx")], "id bigint, text string, lang string")
    docs = spark.createDataFrame([(1, "brug stern")], "doc_id int, text string")
    assert language_id.predict(docs, language_id.train(one)).first().lang_pred == "xx"
    many = spark.createDataFrame([(i, "a", f"l{i}") for i in range(6)], "id bigint, text string, lang string")
    with pytest.raises(ValueError):
        language_id.train(many, max_languages=5)


def test_long_text_equals_its_parts(monkeypatch):
    import pyarrow as pa

    from newslens.llm import ngrams

    text = "some words go here and there " * 4000
    whole = np.concatenate([c for _, c in language_id.histograms(pa.array([text, "x y"]))])
    parts = np.zeros_like(whole[0])
    for rows, _, buckets in ngrams.hashed_ngrams(pa.array([text]), language_id.ORDERS, language_id.BITS, ngrams.LETTERS, 5000):
        parts += np.bincount(buckets, minlength=len(parts))
    # only the n-grams across the 23 cuts differ
    assert abs(whole[0] - parts).sum() <= 24 * 6


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    words = ["river", "stone", "cloud", "paper", "green", "lamp", "moss", "tide"]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(5, 200)))
        label = int(i % 5 == 0)
        if label:
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(["zblorg", "quaxxit"])))
        rows.append((i, " ".join(text), label))
    return rows


def test_toxicity_finds_one_word_in_a_long_text(spark):
    rows = toxic_rows(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 600], "doc_id bigint, toxic int")
    fitted = toxicity.train(*toxicity.labelled_documents(docs, labels))
    more = [(900, None), (901, ""), (902, "river stone " * 30_000 + "quaxxit"), (903, "moss lamp " * 90_000), (5, rows[5][1]), (None, rows[5][1])]
    every = docs.union(spark.createDataFrame(more, docs.schema))
    got = [(r.doc_id, r.score) for r in toxicity.score(every.withColumn("_score", F.lit(1)), fitted).collect()]
    label = {i: y for i, _, y in rows} | {900: 0, 901: 0, 902: 1, 903: 0, None: rows[5][2]}
    assert all((s >= toxicity.THRESHOLD) == bool(label[i]) for i, s in got)
    assert len({s for i, s in got if i in (5, None)}) == 1 and len({s for i, s in got if i in (900, 901)}) == 1


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    for rows, score in (([], 0), ([(1, 0), (4, None)], 0), ([(1, 1), (2, 1)], 1)):
        labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
        fitted = toxicity.train(*toxicity.labelled_documents(docs, labels))
        assert {round(r.score) for r in toxicity.score(docs, fitted).collect()} == {score}
    assert toxicity.score(docs.limit(0), fitted).count() == 0


def test_toxicity_query(spark):
    got = toxicity.op3_query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = got.join(labels, "doc_id").filter("toxic = 0")
    assert got.count() == 1000 and clean.filter("predicted = 1").count() <= 0.01 * clean.count()
