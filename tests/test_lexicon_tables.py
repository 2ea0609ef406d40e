import pytest
from pyspark.sql import functions as F

from newslens.config import Lexicons, RunSettings
from newslens.operators import features, ordering
from newslens.operators.features import MAX_LITERAL_WORDS, lexical_features
from newslens.operators.lexicon_tables import read_verdicts, store_verdicts, table_features, verdict_table, word_hits
from newslens.plans.training import article_evidence, article_features, stage_tables

LEX = Lexicons(("good", "fairly"), ("bad", "good"), ("hoax", "bad"))
NAMES = ["SR", "UL", "SP", "NC", "SQ", "FC"]
TEXTS = [
    (1, "Good news, bad news. Nothing here. A hoax? \"Fairly\" good reuters."),
    (2, ""),
    (3, None),
    (4, "  one   bad\tword  "),
    (5, "nothing at all. Nothing more."),
    (6, "good " * 300 + "end."),
    (7, "Bad. Bad. Bad."),
    (8, "... !!! ()"),
]


def words(spark, values):
    return spark.createDataFrame([(v,) for v in values], "word string")


def verdicts(spark, lex=LEX):
    return verdict_table(words(spark, lex.positive), words(spark, lex.negative), words(spark, lex.unusual))


@pytest.mark.parametrize("hot", [False, True])
def test_table_equals_literals(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(ordering, "MIN_HOT_ROWS", 1)
        monkeypatch.setattr(ordering, "HOT_SHARE", 10)
    df = spark.createDataFrame(TEXTS, "id int, text string")
    table = {r.id: [r[n] for n in NAMES] for r in table_features(df, verdicts(spark)).collect()}
    literal = {r.id: [r[n] for n in NAMES] for r in lexical_features(df, "text", LEX).collect()}
    assert len(table) == len(TEXTS)
    for i, values in literal.items():
        assert table[i] == pytest.approx(values, abs=1e-12), i


def test_verdicts_are_merged_and_cleaned(spark):
    raw = verdict_table(words(spark, [" Good ", "good", "", "  "]), words(spark, ["GOOD", "bad"]), words(spark, []))
    assert {r.word: r.bits for r in raw.collect()} == {"good": 3, "bad": 2}


def test_empty_tables(spark):
    none = verdict_table(*[words(spark, [])] * 3)
    df = spark.createDataFrame(TEXTS, "id int, text string")
    bare = {r.id: (r.SR, r.SP, r.NC) for r in table_features(df, none).collect()}
    literal = {r.id: (r.SR, r.SP, r.NC) for r in lexical_features(df, "text", Lexicons((), (), ())).collect()}
    assert bare == literal
    assert table_features(df.limit(0), verdicts(spark)).count() == 0


def test_run_with_more_words_than_a_literal_list(spark, tmp_path):
    many = words(spark, []).unionByName(spark.range(MAX_LITERAL_WORDS + 5_000).select(F.concat(F.lit("w"), "id").alias("word")))
    odd = many.unionByName(words(spark, ["hoax"]))
    path = store_verdicts(verdict_table(words(spark, ["good"]), words(spark, ["bad"]), odd), str(tmp_path))
    assert read_verdicts(spark, path).count() == MAX_LITERAL_WORDS + 5_003
    rows = [(1, "T", "A hoax, w24999 and w25000. Really good.", 1, "s"), (2, "T", "Plain text.", 0, "s")]
    df = spark.createDataFrame(rows, "id int, title string, text string, label int, source string")
    settings = RunSettings(lexicon_table=path)
    found = {r.id: r for r in article_features(df, settings).collect()}
    assert found[1].UL == pytest.approx(2 / 7) and found[2].UL == 0.0
    record = {f.name: f.evidence.spans for f in article_evidence(df, settings).filter("id = 1").first().features}
    cut = lambda name: [rows[0][2][s.start : s.end] for s in record[name]]
    assert cut("UL") == ["hoax,", "w24999"] and cut("SR") == ["Really", "good."]
    meta = {f.name: f.meta for f in article_evidence(df, settings).first().features}
    assert meta["UL"]["lexicon_size"] == str(MAX_LITERAL_WORDS + 5_001)


def test_stored_table_is_addressed_by_content(spark, tmp_path):
    first = store_verdicts(verdicts(spark), str(tmp_path))
    assert store_verdicts(verdicts(spark), str(tmp_path)) == first
    other = store_verdicts(verdicts(spark, Lexicons(("good",), (), ())), str(tmp_path))
    assert other != first
    rows = [(1, "T", "Good bad hoax text here.", 1, "s"), (2, "T", "Other words.", 0, "s")]
    df = spark.createDataFrame(rows, "id int, title string, text string, label int, source string")
    folder = str(tmp_path / "stages")
    base = RunSettings(seeds=(13,), n_splits=1, max_bits=0)
    one = stage_tables(df, RunSettings(**{**base.__dict__, "lexicon_table": first}), folder)[0]
    two = stage_tables(df, RunSettings(**{**base.__dict__, "lexicon_table": other}), folder)[0]
    assert one.filter("id = 1").first().UL > 0 and two.filter("id = 1").first().UL == 0


@pytest.mark.parametrize("size", [20, 8_000_000])
def test_words_meet_the_lexicon_once_per_chunk(spark, monkeypatch, size):
    """A word that fills a chunk is joined once for it, and chunks of any size give the same hits."""
    monkeypatch.setattr(features, "CHUNK_CHARS", size)
    data = [(i, "good bad " * 40 + f"w{i}. Then good") for i in range(30)]
    df = spark.createDataFrame(data, "id int, text string")
    chunks = features.text_chunks(df, "id", F.col("text"))
    met = features.chunk_verdicts(chunks, verdicts(spark)).collect()
    assert len(met) == len(set(met)) == 2 * chunks.select("_chunk").distinct().count()
    hits = {r._key: (r._hits, r._scores) for r in word_hits(df, verdicts(spark)).collect()}
    assert set(hits) == set(range(30))
    for found, scores in hits.values():
        assert [h.at for h in found] == [*range(80), 82]
        # "good" is positive and negative: (40 - 80) / 120 in the first sentence, 0 in the second
        assert scores == pytest.approx([0.5 * (1 - 1 / 3), 0.5])
    shares = {r.id: (r.hits, r.tokens) for r in features.lexicon_hits(df, words(spark, ["good", "bad"]), "id").collect()}
    assert shares == {i: (81, 83) for i in range(30)}
