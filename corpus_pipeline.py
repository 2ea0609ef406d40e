"""A training-corpus pipeline over ``documents``.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
personal data is masked, and what is left is encoded. Each stage reads what its predecessor wrote. A stage
decides on its own input: models are trained anew on the documents it gets.

Defined results: an empty table passes through every stage; null texts are kept (they are neither
toxic nor duplicates nor contaminated) and encode to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import bpe_pairs, decontamination, minhash, pii, toxicity
from newslens.llm.columns import free_name
from newslens.runtime import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*toxicity.labelled_documents(docs, labels))
    out = free_name(docs, "_toxicity")
    return toxicity.score(docs, model, out=out).filter(F.col(out) < toxicity.THRESHOLD).drop(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays (of several texts under that id the one with the smallest
    digest, of repeated rows the smallest row); documents without id or words stay."""
    groups = materialize(minhash.grouped(docs.select("doc_id", "text")).select("id", "text_digest", "group"), "groups")
    first = groups.filter("group is not null").groupBy("group").agg(F.min(F.struct("id", "text_digest")).alias("first"))
    copies = groups.groupBy("id", "text_digest").agg(F.count(F.lit(1)).alias("n_rows"), F.max("group").alias("group"))
    stay = copies.join(first, "group", "left").filter(F.col("group").isNull() | (F.col("first") == F.struct("id", "text_digest")))
    alone = F.col("group").isNull() | (F.col("n_rows") == 1)
    stay = stay.select(F.col("id").alias("stay_id"), F.col("text_digest").alias("stay_digest"), alone.alias("alone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mine = docs.select(row, F.col("doc_id").cast("bigint").alias("own_id"), minhash.text_digest(F.col("text").cast("string")).alias("own_digest"))
    mine = mine.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_digest") == F.col("stay_digest")))
    repeated = mine.filter(~F.col("alone")).groupBy("own_id", "own_digest").agg(F.min("row").alias("row"))
    return mine.filter("alone").select("row.*").unionByName(repeated.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become the name of their kind; ``n_chars`` follows where the text changed."""
    model = pii.train(docs, "doc_id", "text")
    before = free_name(docs, "_before")
    masked = pii.mask(docs.withColumn(before, F.xxhash64("text")), model)
    changed = F.xxhash64("text") != F.col(before)
    counted = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", counted).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids, decoded_sha256)``: the ids, and a digest of what they decode to."""
    vocab = bpe_pairs.vocabulary_path()
    decoded = bpe_pairs.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), vocab, ids="ids", out="_decoded")
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("_decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]

# Trained models and merge loops are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
