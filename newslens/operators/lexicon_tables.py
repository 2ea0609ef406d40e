"""Lexicons as tables of any size: verdicts per word, brought back to their texts.

A verdict table has one row ``(word, bits)`` per distinct word. Texts are dealt into chunks; the distinct words of a chunk are
joined with the verdicts, and those of a lexicon meet the texts of their chunk again. Nothing is broadcast by assumption and no
lexicon passes through the driver.

Defined results: ids must be unique and not null, as everywhere in a run; a null or empty text has no words; words are
trimmed and lowered, blank ones are dropped; a word in several lexicons counts in each; empty lexicons are allowed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions import text as tx
from newslens.functions.scalars import clip01, let
from newslens.operators.features import SUBJECTIVE_SUFFIXES, chunk_verdicts, fact_confirmation, selective_quoting, share, text_chunks, with_text_parts, word_bits
from newslens.runtime import exists, materialize

POSITIVE, NEGATIVE, UNUSUAL, SUFFIX = 1, 2, 4, 8
HITS = "array<struct<at:int,bits:int>>"


def verdict_table(positive: DataFrame, negative: DataFrame, unusual: DataFrame) -> DataFrame:
    """``(word, bits)`` from three tables with a column ``word``."""
    marked = [
        words.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct().withColumn("bits", F.lit(bit))
        for words, bit in ((positive, POSITIVE), (negative, NEGATIVE), (unusual, UNUSUAL))
    ]
    together = reduce(DataFrame.unionByName, marked)
    return together.groupBy("word").agg(F.sum("bits").cast("int").alias("bits"))


def store_verdicts(verdicts: DataFrame, folder: str) -> str:
    """Write a verdict table under a name made from its content and return the path, for ``RunSettings.lexicon_table``."""
    spark = verdicts.sparkSession
    held = materialize(verdicts.select("word", "bits"), "verdicts")
    n, total = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("word", "bits").cast("decimal(38,0)"))).first()
    path = f"{folder.rstrip('/')}/verdicts-{n}-{int(total or 0) % 2**64:016x}"
    if not exists(spark, f"{path}/_SUCCESS"):
        held.write.mode("overwrite").parquet(path)
    return path


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, bits int").parquet(path)


def ends_subjective(word: Column) -> Column:
    return reduce(lambda a, b: a | b, [word.endswith(s) for s in SUBJECTIVE_SUFFIXES])


def word_hits(df: DataFrame, verdicts: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """``(id, _hits, _scores)`` of the texts that hold a lexicon word.

    ``_hits`` lists place and verdict of every such word in order, ``_scores`` the polarity of every sentence with one.
    """
    chunks = text_chunks(with_text_parts(df.select(id_col, text).filter(F.col(id_col).isNotNull()), text), id_col, F.col("_clean"))
    bits = F.col("bits") + F.when(ends_subjective(F.col("word")), SUFFIX).otherwise(0)
    held = chunk_verdicts(chunks, verdicts.select("word", bits.alias("bits")).filter("bits > 0"))
    kind = chunks.schema["_key"].dataType.simpleString()
    return chunks.groupBy("_chunk").cogroup(held.groupBy("_of")).applyInArrow(_chunk_hits, f"_key {kind}, _hits {HITS}, _scores array<double>")


def _chunk_hits(texts: pa.Table, verdicts: pa.Table) -> pa.Table:
    """Hits and sentence scores of a chunk of texts; rows under one id are one text."""
    keys = texts.column("_key").combine_chunks().dictionary_encode()
    bits, n_words, n_sents = word_bits(texts.column("_clean").combine_chunks(), verdicts, "\n")
    owner = keys.indices.to_numpy()
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    first_sent = np.concatenate([[0], np.cumsum(n_sents)])
    hit = np.flatnonzero(bits)
    sent = np.searchsorted(first_word, hit, side="right") - 1
    row = np.searchsorted(first_sent, sent, side="right") - 1
    at, sent, own, bits = hit - first_word[first_sent[row]], sent - first_sent[row], owner[row], bits[hit]
    by_place = np.lexsort((bits, at, own))
    by_sentence = np.lexsort((sent, own))
    edge = np.flatnonzero(np.diff(own[by_sentence], prepend=-1) | np.diff(sent[by_sentence], prepend=-1))
    pos, neg = (np.add.reduceat((bits[by_sentence] & b > 0).astype(np.int64), edge) if len(edge) else np.zeros(0, np.int64) for b in (POSITIVE, NEGATIVE))
    score = 0.5 * ((pos - neg) / np.maximum(1, pos + neg) + 1.0)
    scored = own[by_sentence][edge]
    places = pa.StructArray.from_arrays([pa.array(at[by_place].astype(np.int32)), pa.array(bits[by_place].astype(np.int32))], names=["at", "bits"])
    many = len(keys.dictionary)
    offsets = lambda of: pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=many))]).astype(np.int32))
    scores = pa.array(score[np.lexsort((score, scored))])
    return pa.table(
        [keys.dictionary, pa.ListArray.from_arrays(offsets(own), places), pa.ListArray.from_arrays(offsets(scored), scores)], names=["_key", "_hits", "_scores"]
    ).filter(pa.array(np.bincount(own, minlength=many) > 0))


def _has(hit: Column, bits: int) -> Column:
    return hit["bits"].bitwiseAND(bits) > 0


def subjective_places() -> Column:
    """Places of subjective words in order: lexicon words and words with a subjective ending."""
    by_ending = F.filter(F.transform("_words", lambda w, i: F.when(ends_subjective(w), i)), lambda i: i.isNotNull())
    by_table = F.transform(F.filter("_hits", lambda h: _has(h, POSITIVE | NEGATIVE) & ~_has(h, SUFFIX)), lambda h: h["at"])
    return F.array_sort(F.concat(by_ending, by_table))


def unusual_places() -> Column:
    return F.transform(F.filter("_hits", lambda h: _has(h, UNUSUAL)), lambda h: h["at"])


def _spread_of(scores: Column, missing: Column, n: Column, mean: Column) -> Column:
    squares = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + (s - mean) * (s - mean))
    return (squares + missing * (F.lit(0.5) - mean) * (F.lit(0.5) - mean)) / n


def table_features(
    df: DataFrame, verdicts: DataFrame, id_col: str = "id", text: str = "text", fact: bool = True, keep_parts: bool = False
) -> DataFrame:
    """SR, UL, SP, NC, SQ (and FC) like ``lexical_features``, with lexicons from a verdict table.

    Sentences without a lexicon word have polarity 0.5 and are counted, not listed.
    """
    hits = word_hits(df, verdicts, id_col, text)
    joined = df.join(hits, F.col(id_col) == F.col("_key"), "left").drop("_key")
    raw = F.coalesce(F.col(text), F.lit(""))
    n, missing = F.size("_sents"), F.size("_sents") - F.size("_scores")
    total = F.aggregate("_scores", F.lit(0.0), lambda acc, s: acc + s) + F.lit(0.5) * missing
    out = (
        with_text_parts(joined, text)
        .withColumn("_hits", F.coalesce("_hits", F.array().cast(HITS)))
        .withColumn("_scores", F.coalesce("_scores", F.array().cast("array<double>")))
        .withColumn("_subjective", subjective_places())
        .withColumn("_unusual", unusual_places())
        .withColumn("SR", clip01(share(F.size("_subjective"), F.col("_words"))))
        .withColumn("UL", clip01(share(F.size("_unusual"), F.col("_words"))))
        .withColumn("SP", clip01(F.when(n > 0, total / n).otherwise(F.lit(0.0))))
        .withColumn(
            "NC",
            clip01(
                F.when(n > 0, let(total / n, lambda m: F.lit(1.0) - _spread_of(F.col("_scores"), missing, n, m))).otherwise(
                    F.lit(1.0)
                )
            ),
        )
        .withColumn("SQ", selective_quoting(raw, F.col("_squeezed")))
    )
    if fact:
        out = out.withColumn("FC", fact_confirmation(raw))
    parts = ["_squeezed", "_marked", "_clean", "_sents", "_sent_words", "_words", "_subjective", "_unusual"]
    return out.drop("_hits", "_scores", *([] if keep_parts else parts))
