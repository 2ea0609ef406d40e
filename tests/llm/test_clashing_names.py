"""Columns that clash with a result column in another case are replaced by it."""

from newslens.llm import bpe_pairs, pii, toxicity


def test_result_column_in_another_case(spark):
    docs = spark.createDataFrame([(1, "a text", "old", "old", "old")], "doc_id bigint, text string, IDS string, SCORE string, PII_SPANS string")
    vocab = bpe_pairs.vocabulary_path()
    coded = bpe_pairs.encode(docs, vocab)
    assert "IDS" not in coded.columns and bpe_pairs.decode(coded, vocab, out="Text").first()["Text"] == "a text"
    model = toxicity.train(*toxicity.labelled_documents(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id bigint, toxic int")))
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "IDS", "PII_SPANS", "score"]
    assert pii.find_personal_data(docs, None).columns == ["doc_id", "text", "IDS", "SCORE", "pii_spans"]
