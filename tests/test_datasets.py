import pytest
from pyspark.sql import functions as F

from newslens.config import Cleaning, DatasetSpec
from newslens.functions.scalars import label_code, label_name, standard_label
from newslens.operators import corpus
from newslens.operators import standardize as st
from newslens.operators.ordering import dense_index
from newslens.plans.datasets import process_custom, process_dataset, process_many
from newslens.sources import readers, writers


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize(
    "raw, expected",
    [("fake", "fake"), ("FAKE", "fake"), ("false", "fake"), ("0", "fake"), ("hoax", "fake"), ("real", "real"), ("REAL", "real"),
     ("true", "real"), ("1", "real"), ("genuine", "real"), ("barely-true", "real"), ("pants-fire", "pants-fire"), ("Unreal", "real"),
     (" False ", "fake"), (None, None)],
)
def test_standard_label(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "v string").select(standard_label(F.col("v"))).first()[0] == expected


def test_label_code_and_back(spark):
    df = spark.createDataFrame([("fake",), ("real",), ("half",)], "v string").select(label_code(F.col("v")).alias("c"))
    assert [r.c for r in df.collect()] == [0, 1, None]
    assert [r[0] for r in df.select(label_name(F.col("c"))).collect()] == ["fake", "real", None]


def test_two_file_layout(spark, tmp_path):
    put(tmp_path, "Fake.csv", "title,text\nfake title,fake text\n")
    put(tmp_path, "True.csv", "title,text\ntrue title,true text\n")
    rows = {r.id: r for r in readers.read_two_file(spark, str(tmp_path)).collect()}
    assert {k: v.label for k, v in rows.items()} == {"fake_0": 0, "real_0": 1}


def test_sample_and_unknown_label(spark, tmp_path):
    put(tmp_path, "s.csv", 'id,title,text,label\n1,"A, b","Two\nlines",Real\n2,B,"He said ""x""", fake \n')
    rows = readers.read_sample(spark, f"{tmp_path}/s.csv").orderBy("id").collect()
    assert [(r.label, r.text) for r in rows] == [(1, "Two\nlines"), (0, 'He said "x"')]
    put(tmp_path, "bad.csv", "id,title,text,label\n1,A,B,maybe\n")
    with pytest.raises(Exception, match="unknown label: maybe"):
        readers.read_sample(spark, f"{tmp_path}/bad.csv").collect()


def test_files_with_other_columns_and_suffixes(spark, tmp_path):
    put(tmp_path, "a.csv", "text,label\nfirst,fake\n")
    put(tmp_path, "b.csv", "label,text,extra\nreal,second,x\n")
    put(tmp_path, "c.txt", "text,label\nthird,fake\n")
    rows = {r.text: (r.label, r.extra) for r in readers.read_csv(spark, str(tmp_path), ["a.*", "*.csv"][1:]).collect()}
    assert rows == {"first": ("fake", None), "second": ("real", "x")}
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path), ["*.tsv"])
    with pytest.raises(FileNotFoundError):
        readers.read_tsv(spark, str(tmp_path), ["c.txt"])
    with pytest.raises(ValueError):
        readers.read_dataset(spark, DatasetSpec("x", ("*.csv",), "xml"), str(tmp_path))


def test_json_records(spark, tmp_path):
    put(tmp_path, "p.json", '[{"statement": "s1", "ruling": true}, {"statement": "s2", "ruling": "half-true"}]')
    spec = DatasetSpec("politifact", ("*.json",), "json", ("statement",), "ruling")
    rows = {r.text: r.label for r in process_dataset(spark, spec, str(tmp_path)).collect()}
    assert rows == {"s1": "real", "s2": "real"}


def test_custom_mapping(spark, tmp_path):
    put(tmp_path, "d.csv", "content,headline,veracity\nText 1,T1,FAKE\nText 2,T2,true\nText 3,,0\nText 4,T4,verified\n")
    df = process_custom(spark, str(tmp_path), ["content"], "veracity", "headline", name="test")
    assert df.columns == ["text", "title", "label", "source", "id"]
    rows = {r.id: r for r in df.collect()}
    assert rows["test_0"].text == "Text 1" and rows["test_0"].title == "T1" and rows["test_0"].label == "fake"
    assert rows["test_2"].title is None
    assert sorted(r.label for r in rows.values()) == ["fake", "fake", "real", "real"]
    with pytest.raises(KeyError):
        process_custom(spark, str(tmp_path), ["content"], "nope")


def test_label_by_file(spark, tmp_path):
    put(tmp_path, "Fake.csv", "title,text\na,b\n")
    put(tmp_path, "True.csv", "title,text\nc,d\n")
    from newslens.config import DATASETS

    rows = {r.text: r.label for r in process_dataset(spark, DATASETS["isot"], str(tmp_path)).collect()}
    assert rows == {"b": "fake", "d": "real"}


def test_multi_text_and_missing(spark):
    df = spark.createDataFrame([(1, "a", "b", "fake"), (2, None, "c", "real"), (3, None, None, None)], "k int, x string, y string, l string")
    spec = DatasetSpec("d", (), "csv", ("x", "y"), "l")
    rows = st.standardize(df, spec, order_by="k").orderBy("id").collect()
    assert [(r.id, r.text, r.label) for r in rows] == [("d_0", "a b", "fake"), ("d_1", "c", "real"), ("d_2", None, None)]
    assert st.drop_missing(st.standardize(df, spec, order_by="k")).count() == 2


def test_dense_index_in_scan_order(spark, tmp_path):
    spark.range(0, 1000, 1, 7).write.parquet(f"{tmp_path}/t")
    got = dense_index(spark.read.parquet(f"{tmp_path}/t"), "i").select("i").collect()
    assert sorted(r.i for r in got) == list(range(1000))


def test_cleaning(spark):
    rows = [(3, "A long enough text", "real"), (1, "A long enough text", "fake"), (2, "Short", "fake"), (4, None, "real"), (5, "Another long enough text", None)]
    df = spark.createDataFrame(rows, "k int, text string, label string")
    out = st.clean(df, Cleaning(remove_duplicates=True, min_text_length=15), "k").collect()
    assert [(r.k, r.label) for r in out] == [(1, "fake")]
    kept = st.clean(df, Cleaning(remove_missing=False, filters=(lambda d: d.filter("k > 3"),)), "k").collect()
    assert [r.k for r in kept] == [5]


def test_validation(spark):
    df = spark.createDataFrame([("fake",)] * 3 + [("real",)] * 2 + [("odd",)], "label string")
    report = {r.label: (r.n, r.enough, r.known) for r in st.validation_report(df, 2, ("fake", "real")).collect()}
    assert report == {"fake": (3, True, True), "real": (2, True, True), "odd": (1, False, False)}
    with pytest.raises(ValueError):
        st.require_valid(df, Cleaning(allowed_labels=("fake", "real")))


def test_combine_and_balance(spark):
    cols = "id string, text string, label string, source string"
    one = spark.createDataFrame([(f"a{i}", "t", "fake" if i % 4 else "real", "a") for i in range(40)], cols)
    two = spark.createDataFrame([(f"b{i}", "t", "other" if i % 4 else "real", "b") for i in range(40)], cols)
    both = corpus.combine([one, two])
    assert both.count() == 80
    out = corpus.balance(both)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"fake": 20, "real": 20}
    ids = {r.id for r in out.collect()}
    assert ids == {r.id for r in corpus.balance(both.repartition(7)).collect()}
    assert corpus.balance(one.filter("label = 'fake'")).count() == 0


def test_statistics(spark):
    rows = [("Text one", "fake", "test", "A"), ("Text two!", "fake", "test", ""), ("Three", "real", "test", "C")]
    got = {(r.metric, r.key): r.value for r in corpus.statistics(spark.createDataFrame(rows, "text string, label string, source string, title string")).collect()}
    assert got[("total_samples", "")] == 3 and got[("label_distribution", "fake")] == 2 and got[("label_distribution", "real")] == 1
    assert got[("source_distribution", "test")] == 3 and got[("has_title", "")] == 2
    assert got[("avg_word_count", "")] == pytest.approx(5 / 3)


def test_many_datasets_isolate_failures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    put(tmp_path / "a", "x.csv", "text,label\nsome longer text,fake\nother longer text,real\n")
    registry = {n: DatasetSpec(n, ("*.csv",)) for n in ("a", "gone")}
    folders = {"a": str(tmp_path / "a"), "gone": str(tmp_path / "gone")}
    status, merged = process_many(spark, "a,gone,what", folders, str(tmp_path / "out"), registry, combined=True)
    assert {r.dataset: r.status for r in status.collect()} == {"a": "ok", "gone": "failed", "what": "skipped"}
    assert merged.count() == 2
    out = writers.integrate(spark, str(tmp_path / "out"), str(tmp_path / "merged"))
    assert {r.label: r["count"] for r in spark.read.parquet(out).groupBy("label").count().collect()} == {"fake": 1, "real": 1}


def test_csv_round_trip(spark, tmp_path):
    texts = [' leading and "quoted", ', "two\nlines", "tab\tinside", "", "a\\b"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    writers.write_processed(df, str(tmp_path), "x", "csv")
    back = {r.id: r.text for r in writers.read_processed(spark, str(tmp_path), "csv").collect()}
    assert back == {str(i): t for i, t in enumerate(texts)} or back == {str(i): t or None for i, t in enumerate(texts)}


def test_missing_lexicon_is_empty(spark, tmp_path):
    assert readers.read_lexicon(spark, str(tmp_path / "none.txt")).count() == 0
    put(tmp_path, "w.txt", "Good\n\n  bad \ngood\n")
    assert readers.lexicon_words(readers.read_lexicon(spark, f"{tmp_path}/w.txt")) == ("bad", "good")
