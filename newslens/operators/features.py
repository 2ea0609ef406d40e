"""Interpretable lexical features of one text, all JVM expressions in one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.config import FACT_KEYWORDS, Lexicons
from newslens.functions import text as tx
from newslens.functions.scalars import clip01, let
from newslens.runtime import materialize

# Subjective suffixes, quote characters, and the quoting weights.
SUBJECTIVE_SUFFIXES = ("ly", "ive", "ous")
STRAIGHT_QUOTE, OPEN_QUOTE, CLOSE_QUOTE = '"', "“", "”"
QUOTE_SHARE_WEIGHT, QUOTE_COUNT_WEIGHT = 0.7, 0.3

# Literal word sets are compiled into the plan; beyond this size use
# :func:`lexicon_hits`, which joins instead.
MAX_LITERAL_WORDS = 20_000
# Characters of the texts that a task holds next to their lexicon words.
CHUNK_CHARS = 8_000_000


def in_lexicon(word: Column, lexicon) -> Column:
    """Hash-set membership in a literal word list of checked size."""
    vocabulary = sorted({w.strip().lower() for w in lexicon if w.strip()})
    if len(vocabulary) > MAX_LITERAL_WORDS:
        raise ValueError(f"{len(vocabulary)} words: pass a lexicon table to lexicon_hits instead")
    return word.isin(*vocabulary) if vocabulary else F.lit(False)


def is_subjective(word: Column, lex: Lexicons) -> Column:
    test = in_lexicon(word, lex.positive + lex.negative)
    for suffix in SUBJECTIVE_SUFFIXES:
        test = test | word.endswith(suffix)
    return test


def with_text_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add squeezed text, sentences and cleaned words per sentence, each computed once."""
    return (
        df.withColumn("_squeezed", tx.squeeze(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_marked", tx.mark_sentences(F.col("_squeezed")))
        .withColumn("_sents", tx.pieces(F.col("_marked"), "\n"))
        .withColumn("_clean", tx.mark_clean(F.col("_marked")))
        .withColumn(
            "_sent_words",
            F.when(F.col("_squeezed") == "", F.array().cast("array<array<string>>")).otherwise(
                F.transform(F.split("_clean", "\n"), lambda s: F.split(s, " "))
            ),
        )
        .withColumn("_words", F.flatten("_sent_words"))
    )


def share(hits: Column, array: Column) -> Column:
    return hits / F.greatest(F.lit(1), F.size(array))


def subjectivity(lex: Lexicons) -> Column:
    w = F.col("_words")
    return share(tx.count_where(w, lambda t: is_subjective(t, lex)), w)


def unusual_share(lex: Lexicons) -> Column:
    w = F.col("_words")
    return share(tx.count_where(w, lambda t: in_lexicon(t, lex.unusual)), w)


def sentence_polarity(lex: Lexicons) -> Column:
    """Per sentence (pos - neg) / max(1, pos + neg), mapped to [0, 1]."""

    def score(ws: Column) -> Column:
        pos = tx.count_where(ws, lambda t: in_lexicon(t, lex.positive))
        neg = tx.count_where(ws, lambda t: in_lexicon(t, lex.negative))
        both = F.struct(pos.alias("pos"), neg.alias("neg"))
        return let(
            both,
            lambda c: F.lit(0.5) * ((c["pos"] - c["neg"]) / F.greatest(F.lit(1), c["pos"] + c["neg"]) + F.lit(1.0)),
        )

    return F.transform("_sent_words", score)


def array_mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / F.size(xs)


def array_var_pop(xs: Column, mean: Column) -> Column:
    return let(mean, lambda m: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))) / F.size(xs)


def occurrences(text: Column, char: str) -> Column:
    return F.when(~text.contains(char), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(char), F.lit(""))))


def quote_count(text: Column) -> Column:
    """Quoted spans: half the marks of each kind, rounded down."""
    halves = [F.floor(occurrences(text, c) / 2) for c in (STRAIGHT_QUOTE, OPEN_QUOTE, CLOSE_QUOTE)]
    return (halves[0] + halves[1] + halves[2]).cast("int")


def selective_quoting(text: Column, squeezed: Column) -> Column:
    raw = tx.words(squeezed)
    quoted = tx.count_where(
        raw,
        lambda t: t.startswith(STRAIGHT_QUOTE)
        | t.endswith(STRAIGHT_QUOTE)
        | t.contains(OPEN_QUOTE)
        | t.contains(CLOSE_QUOTE),
    )
    has_mark = text.contains(STRAIGHT_QUOTE) | text.contains(OPEN_QUOTE) | text.contains(CLOSE_QUOTE)
    value = F.lit(QUOTE_SHARE_WEIGHT) * share(quoted, raw) + F.lit(QUOTE_COUNT_WEIGHT) * (
        F.lit(1.0) - F.exp(-quote_count(text).cast("double"))
    )
    # most texts carry no quotation mark: skip tokenising them again
    return F.when(has_mark, clip01(value)).otherwise(F.lit(0.0))


def keyword_hits(text: Column) -> Column:
    return let(F.lower(text), lambda lowered: sum((F.when(lowered.contains(k), 1).otherwise(0) for k in FACT_KEYWORDS), F.lit(0)))


def fact_confirmation(text: Column) -> Column:
    return F.when(keyword_hits(text) > 0, 1.0).otherwise(0.0)


def lexical_features(
    df: DataFrame, text: str = "text", lex: Lexicons | None = None, fact: bool = True, keep_parts: bool = False
) -> DataFrame:
    """Add SR, UL, SP, NC, SQ (and FC). A narrow projection: no shuffle at any size."""
    lex = lex or Lexicons()
    raw = F.coalesce(F.col(text), F.lit(""))
    out = (
        with_text_parts(df, text)
        .withColumn("SR", clip01(subjectivity(lex)))
        .withColumn("UL", clip01(unusual_share(lex)))
        .withColumn("_polarity", sentence_polarity(lex))
        .withColumn("_polarity_mean", F.when(F.size("_polarity") > 0, array_mean(F.col("_polarity"))))
        .withColumn("SP", clip01(F.coalesce("_polarity_mean", F.lit(0.0))))
        .withColumn(
            "NC",
            clip01(
                F.when(
                    F.size("_polarity") > 0, F.lit(1.0) - array_var_pop(F.col("_polarity"), F.col("_polarity_mean"))
                ).otherwise(F.lit(1.0))
            ),
        )
        .withColumn("SQ", selective_quoting(raw, F.col("_squeezed")))
    )
    if fact:
        out = out.withColumn("FC", fact_confirmation(raw))
    drop = ["_polarity_mean"] + ([] if keep_parts else ["_squeezed", "_marked", "_clean", "_sents", "_sent_words", "_words", "_polarity"])
    return out.drop(*drop)


def text_chunks(df: DataFrame, id_col: str, clean: Column) -> DataFrame:
    """``(_key, _clean, _chunk)``, stored: cleaned texts dealt by their id into chunks of about ``CHUNK_CHARS`` characters."""
    kept = materialize(df.select(F.col(id_col).alias("_key"), clean.alias("_clean")), "clean-texts")
    size = kept.agg(F.sum(F.length("_clean"))).first()[0] or 0
    return kept.withColumn("_chunk", F.pmod(F.xxhash64("_key"), F.lit(max(1, -(-size // CHUNK_CHARS)))))


def chunk_verdicts(chunks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(_of, word, bits)`` of the lexicon words ``(word, bits)`` in each chunk.

    A word meets the lexicon once per chunk, however often it occurs, so no word is hot.
    """
    held = chunks.select("_chunk", "_clean").repartition("_chunk").select("_chunk", F.explode(F.array_distinct(F.split("_clean", "[ \n]"))).alias("word"))
    return held.groupBy("_chunk", "word").agg(F.lit(1).alias("_one")).drop("_one").join(verdicts.select("word", "bits"), "word").select(F.col("_chunk").alias("_of"), "word", "bits")


def word_bits(clean: pa.Array, verdicts: pa.Table, separator: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of the texts its bits (0: not in the lexicon); per piece of a text its number of words, and per text of its pieces.

    An empty text has one piece with one empty word.
    """
    pieces = pc.split_pattern(clean, separator)
    words = pc.split_pattern(pieces.flatten(), " ")
    at = pc.fill_null(pc.index_in(words.flatten(), value_set=verdicts.column("word").combine_chunks()), -1).to_numpy(zero_copy_only=False)
    bits = np.append(verdicts.column("bits").to_numpy().astype(np.int32), np.int32(0))[at]
    return bits, np.diff(words.offsets.to_numpy()), np.diff(pieces.offsets.to_numpy())


def lexicon_hits(df: DataFrame, lexicon: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Token share in a lexicon *table* of any size, as ``(id, hits, tokens, share)``.

    Texts are dealt into chunks; the words of a chunk are joined with the lexicon, once each, and meet the chunk's texts again.
    """
    squeezed = tx.squeeze(F.coalesce(F.col(text), F.lit("")))
    chunks = text_chunks(df, id_col, tx.mark_clean(squeezed))
    known = lexicon.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct().withColumn("bits", F.lit(1))

    def run(texts: pa.Table, verdicts: pa.Table) -> pa.Table:
        clean = texts.column("_clean").combine_chunks()
        bits, tokens, _ = word_bits(clean, verdicts, "\n")
        tokens = np.where(pc.equal(clean, "").to_numpy(zero_copy_only=False), 0, tokens)
        ends = np.cumsum(np.maximum(tokens, 1))
        before = np.concatenate([[0], np.cumsum(bits > 0)])
        hits = before[ends] - before[ends - np.maximum(tokens, 1)]
        return pa.table([texts.column("_key"), pa.array(hits.astype(np.int64)), pa.array(tokens.astype(np.int64))], names=["_key", "_hits", "_tokens"])

    kind = chunks.schema["_key"].dataType.simpleString()
    counted = chunks.groupBy("_chunk").cogroup(chunk_verdicts(chunks, known).groupBy("_of")).applyInArrow(run, f"_key {kind}, _hits bigint, _tokens bigint")
    return (
        counted.groupBy(F.col("_key").alias(id_col))
        .agg(F.sum("_hits").alias("hits"), F.sum("_tokens").alias("tokens"))
        .withColumn("share", F.col("hits") / F.greatest(F.lit(1), F.col("tokens")))
    )
