import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.config import Lexicons, RunSettings
from newslens.functions import text as tx
from newslens.operators import ordering
from newslens.functions.encoders import hash_encoder, pick_encoder
from newslens.operators.evidence import spaced_words, token_spans
from newslens.operators.features import lexical_features, lexicon_hits, with_text_parts
from newslens.plans.training import article_evidence, article_features

LEX = Lexicons(("good",), ("bad",), ("hoax", "rumor"))


def feature_rows(spark, texts, title="A headline"):
    rows = [(str(i), title, t, 0, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, title string, text string, label int, source string")
    return {int(r.id): r for r in article_features(df, RunSettings(lexicons=LEX)).collect()}


def test_sentences_and_words(spark):
    text = "One two.  Three\tfour! 5 is here? no split. (Quoted.) -- ..."
    row = (
        spark.createDataFrame([(text,), ("",), (" x ",)], "text string")
        .select(tx.squeeze(F.col("text")).alias("s"))
        .select(tx.pieces(tx.mark_sentences(F.col("s")), "\n").alias("sents"), tx.clean_words(F.col("s")).alias("w"))
        .collect()
    )
    assert row[0].sents == ["One two.", "Three four!", "5 is here? no split. (Quoted.) -- ..."]
    assert row[0].w == ["one", "two", "three", "four", "5", "is", "here", "no", "split", "quoted", "--", ""]
    assert row[1].sents == [] and row[1].w == []
    assert row[2].sents == ["x"]


def test_unicode_space(spark):
    df = spark.createDataFrame([("a b c\x1cd",)], "text string")
    assert df.select(tx.words(tx.squeeze(F.col("text")))).first()[0] == ["a", "b", "c", "d"]


def test_empty_text(spark):
    r = feature_rows(spark, ["", None])[1]
    assert (r.PR, r.SR, r.UL, r.SP, r.NC, r.SQ, r.FC) == (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def test_paraphrasing(spark):
    r = feature_rows(spark, ["Only one sentence here.", "The cat sat. The cat sat. The cat sat.", "Red fox. Blue sky. Green tree."])
    assert r[0].PR == 0.0
    assert r[1].PR > 0.99
    assert r[2].PR == pytest.approx(0.0)


def test_paraphrasing_equals_all_pairs(spark):
    rng = random.Random(3)
    texts = [" ".join(" ".join(rng.choices("abcdefgh", k=6)).capitalize() + "." for _ in range(rng.randint(2, 9))) for _ in range(20)]
    got, enc = feature_rows(spark, texts), hash_encoder()
    for i, t in enumerate(texts):
        v = enc([s if s.endswith(".") else s + "." for s in t.split(". ")])
        pairs = [a @ b for k, a in enumerate(v) for b in v[k + 1 :]]
        assert got[i].PR == pytest.approx(np.mean(pairs), abs=1e-9)


def test_lexicon_features(spark):
    r = feature_rows(spark, ["A good day quickly passes.", "This is a hoax!", "Good. Good. Good.", "Good. Bad. Good.", 'He said "yes" and "no".', "plain paper"])
    assert r[0].SR == pytest.approx(2 / 5)
    assert r[0].UL == 0.0 and r[1].UL == pytest.approx(1 / 4)
    assert r[2].SP > 0.5 and r[2].NC > 0.9
    assert r[3].SP < r[2].SP and r[3].NC < r[2].NC
    assert r[4].SQ == pytest.approx(0.7 * 2 / 5 + 0.3 * (1 - math.exp(-2)))
    assert r[5].FC == 1.0
    for row in r.values():
        assert all(0.0 <= row[c] <= 1.0 for c in ("PR", "SR", "HS", "UL", "SP", "NC", "SQ", "FC"))


def test_title_equal_to_lead(spark):
    assert feature_rows(spark, ["Same words here."], "Same words here.")[0].HS == pytest.approx(1.0)


def test_spans_point_at_words(spark):
    text = "  Really\n\ngood,   (hoax)  end good "
    df = with_text_parts(spark.createDataFrame([(text,)], "text string"))
    df = df.withColumn("_spaced", spaced_words(F.col("text"), F.col("_squeezed")))
    spans = df.select(token_spans(F.col("_words"), F.col("_spaced"), lambda w: w.isin("good", "hoax")).alias("s")).first().s
    assert [text[a:b] for a, b in spans] == ["good,", "(hoax)", "good"]


def test_span_limit_and_record(spark):
    rows = [("1", "t", "good " * 40 + "source: ap", 1, "s")]
    df = spark.createDataFrame(rows, "id string, title string, text string, label int, source string")
    rec = {f.name: f for f in article_evidence(df, RunSettings(lexicons=LEX)).first().features}
    assert list(rec) == ["PR", "SR", "HS", "UL", "SP", "NC", "SQ", "FC"]
    assert len(rec["SR"].evidence.spans) == 30 and rec["SR"].evidence.spans[1] == (5, 9)
    assert rec["FC"].meta == {"keywords_checked": "6", "hits": "2"}
    assert rec["PR"].evidence.notes == "single sentence"


@pytest.mark.parametrize("hot", [False, True])
def test_lexicon_table_matches_literals(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(ordering, "MIN_HOT_ROWS", 2)
        monkeypatch.setattr(ordering, "HOT_SHARE", 10)
    texts = [(i, "good bad " * i + "other, words") for i in range(5)] + [(9, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    words = spark.createDataFrame([("Good",), (" hoax ",), ("",)], "word string")
    table = {r.id: r for r in lexicon_hits(df, words, "id").collect()}
    literal = {r.id: r.UL for r in lexical_features(df, "text", Lexicons((), (), ("good", "hoax"))).collect()}
    assert {k: v.share for k, v in table.items()} == pytest.approx(literal)
    assert table[9].tokens == 0


def test_long_text_is_processed_whole(spark):
    text = " ".join(f"Word{i} good." for i in range(6000))
    r = feature_rows(spark, [text])[0]
    assert r.SR == pytest.approx(0.5) and 0.0 < r.PR < 1.0


def test_encoder_choice():
    def broken():
        raise RuntimeError("no model")

    assert pick_encoder("auto", broken)()(["a b"]).shape == (1, 512)
    with pytest.raises(RuntimeError):
        pick_encoder("st", broken)()
    with pytest.raises(ValueError):
        pick_encoder("st")
    with pytest.raises(ValueError):
        pick_encoder("other")


def test_patterns_equal_the_plain_ones(spark):
    rng = np.random.default_rng(7)
    marks = ["a", "B", " ", " ", "\n", "\t", "\x1c", "\x1f", " ", "　", ".", ",", "(", "]", "'", "\U0001f600", "9"]
    rows = [("".join(rng.choice(marks, rng.integers(0, 30))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "text string")
    plain = F.trim(F.regexp_replace("text", tx.SPACE + "+", " "))
    edges = r"""(?<![^ \n])[.,!?;:'"()\[\]{}]+|[.,!?;:'"()\[\]{}]+(?![^ \n])"""
    assert df.filter(plain != tx.squeeze(F.col("text"))).isEmpty()
    assert df.filter(F.regexp_replace(F.lower("text"), edges, "") != tx.mark_clean(F.col("text"))).isEmpty()


def test_sums_of_entries_equal_those_of_whole_vectors():
    import pyarrow as pa

    from newslens.operators import embedding as em

    enc, rng = hash_encoder(), np.random.default_rng(8)
    texts = [[" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9))) for _ in range(rng.integers(0, 60))] for _ in range(90)]
    sents = pa.array([*texts, [], [""]], pa.list_(pa.string()))
    for found, want in zip(em._sentence_sums(enc, sents, 7), em._sentence_sums(lambda t: enc(t), sents, 7)):
        assert np.allclose(found, want, atol=1e-12)


def test_spans_slice_only_as_far_as_they_reach(spark):
    from newslens.operators.evidence import spans_at

    df = spark.createDataFrame([([1, 3, 9], ["a", " bc", " d", " ef", " g"]), ([], ["a"]), ([0], ["xy"])], "hits array<int>, spaced array<string>")
    got = [[tuple(s) for s in r[0]] for r in df.select(spans_at(F.col("hits"), F.col("spaced"), 2)).collect()]
    assert got == [[(2, 4), (7, 9)], [], [(0, 2)]]


def test_first_sentence_of_the_head_is_that_of_the_text(spark):
    from catalog.common import HEAD, first_sentence

    texts = ["A. B", "x" * HEAD + ". B c", " A. " + " " * HEAD + "B c", "", None, " ", "a " * (HEAD // 2 - 2) + "b. C d", "y" * (HEAD - 2) + ". C d", "z" * (HEAD - 3) + ". C d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.get(tx.pieces(tx.mark_sentences(tx.squeeze(F.col("text"))), "\n"), 0)
    assert df.filter(~whole.eqNullSafe(first_sentence(F.col("text")))).isEmpty()
