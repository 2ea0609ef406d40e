"""Every stage of the pipeline against plain Python on what its predecessor kept."""

from hashlib import sha256

import pytest
from test_near_duplicates import brute
from test_scans import plain_report

import corpus_pipeline as cp
from newslens.llm import bpe_pairs, pii, pretokens
from newslens.runtime import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90_001, None, "en", "s", 0), (90_002, "", "en", "s", 0), (None, "no id at all", "en", "s", 12), (90_003, "same row twice", "en", "s", 14), (90_003, "same row twice", "en", "s", 14)]
    tables = [docs.select(*COLUMNS).union(spark.createDataFrame(extra, docs.select(*COLUMNS).schema))]
    for name, stage in cp.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF), f"test-{name}"))
    return tables


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_are_the_five_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]


def test_toxicity_keeps_clean_documents(spark, stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    assert stages[1].columns == COLUMNS and {90_001, 90_002, None} <= kept
    assert set(rows(stages[1])) <= set(rows(stages[0]))


def test_one_of_each_group_stays(stages):
    before = rows(stages[1])
    root = brute(before)
    want = sorted({(i, t) for i, t in before if root.get(i, i) == i}, key=repr)
    assert rows(stages[2]) == want and stages[2].columns == COLUMNS


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for i, t in rows(stages[2]):
        n, hit, _ = plain_report(t, items)
        if not (hit and 20 * len(hit) >= n):
            want.append((i, t))
    assert rows(stages[3]) == want


def test_personal_data_is_masked(stages):
    before, after = dict(rows(stages[3])), dict(rows(stages[4]))
    assert before.keys() == after.keys()
    for i, text in before.items():
        kept, refused = pii.base_spans(text or "")
        left = pii.base_spans(after[i] or "")[0]
        assert not left
        if not kept and text is not None and not any(c.isdigit() or c == "@" for c in text):
            assert after[i] == text
    lengths = {r.doc_id: r.n_chars for r in stages[4].collect()}
    assert all(lengths[i] == len(t) for i, t in after.items() if t != before[i])


def test_encoding_round_trip(stages):
    tokenizer = pretokens.Vocabulary(bpe_pairs.vocabulary_path()).tokenizer
    after = dict(rows(stages[4]))
    got = stages[5].collect()
    assert len(got) == len(after)
    for r in got:
        text = after[r.doc_id] or ""
        assert r.ids == tokenizer.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_empty_table_passes_through(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_distinct_texts_under_one_id_both_stay(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a, "en"), (5, b, "en"), (5, a, "en"), (5, a + " x", "en"), (7, b + " x", "de"), (None, a, "en"), (None, None, None), (8, "", "en"), (8, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = [tuple(r) for r in cp.drop_near_duplicates(spark, docs, "").collect()]
    of_five = [t for i, t, _ in kept if i == 5]
    assert len(of_five) == 2 and {t[0] for t in of_five} == {"a", "b"}
    assert sorted(map(repr, kept)) == sorted(map(repr, [(5, t, "en") for t in of_five] + rows[5:]))
