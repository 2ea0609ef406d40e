"""Toxicity: a character n-gram linear classifier over naive Bayes scaled features.

A feature is the presence of a hashed byte n-gram. Its log-count ratio between the two labels
scales it (Wang and Manning, 2012), and a logistic regression on the scaled features gives the
score, under even priors of the two labels. The classifier is fitted on at most about ``per_label``
labelled texts of either label, chosen by a hash of the id. Scoring reads whole texts, and each
n-gram counts once however long the text is.

Defined results: null and empty texts get the score of a text without features; without labelled
rows of both labels every score is 1 or 0, after the only label there is (0 if there is none). Several labels of
one id count as toxic if one of them is; null labels are skipped; repeated documents get repeated scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.language_id import remainder
from newslens.llm.ngrams import CHARACTERS, hashed_ngrams
from newslens.llm.pretokens import forget
from newslens.runtime import materialize

OWNER = "toxicity"
ORDERS = (4, 6)
BITS = 20
PER_LABEL = 3000
FEATURES = 8192
SMOOTHING = 1.0
PENALTY = 1.0
STEPS = 300
THRESHOLD = 0.7


def present(texts: pa.Array, slot: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, distinct features)`` of every text that has any.

    Without ``slot`` features are buckets; with it they are slots, and buckets with slot -1 are skipped.
    """
    open_row, held = -1, []
    for rows, of, buckets in hashed_ngrams(texts, ORDERS, BITS, CHARACTERS):
        features = buckets if slot is None else slot[buckets]
        if slot is not None:
            of, features = of[features >= 0], features[features >= 0]
        keys = np.unique(of.astype(np.int64) << 32 | features)
        of, features = (keys >> 32).astype(np.int64), (keys & 0xFFFFFFFF).astype(np.int32)
        cuts = np.searchsorted(of, np.arange(len(rows) + 1))
        for k, row in enumerate(rows.tolist()):
            if row != open_row:
                if held:
                    yield open_row, np.unique(np.concatenate(held))
                open_row, held = row, []
            held.append(features[cuts[k] : cuts[k + 1]])
    if held:
        yield open_row, np.unique(np.concatenate(held))


@dataclass
class Model:
    slot: np.ndarray  # bucket -> feature or -1
    weight: np.ndarray  # of a feature, its log-count ratio included
    bias: float

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -60, 60)))


def fit_logistic(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the sparse scaled rows; a rare label counts as much as the other."""
    n, width = len(labels), len(ratio)
    value = ratio[features]
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    w, b = np.zeros(width), 0.0
    at_w, at_b = w, b
    norms = np.bincount(rows, value * value, n) + 1
    rate = 1 / (0.25 * float((share * norms).sum()) + PENALTY / n)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, value * at_w[features], n) + at_b
        slope = share * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels)
        new_w = at_w - rate * (np.bincount(features, value * slope[rows], width) + PENALTY / n * at_w)
        new_b = at_b - rate * slope.sum()
        momentum = step / (step + 3)
        at_w, at_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    return w * ratio, b


def train(labelled: DataFrame, sizes: dict[int, int], features: int = FEATURES) -> Model:
    """``labelled`` is a sample ``text, label``, ``sizes`` the labels of all rows it was drawn from.

    Counts and features come from the tasks, the fit is small.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for row, found in present(batch.column(0)):
                total[int(labels[row]), found] += 1
        some = np.flatnonzero(total.any(axis=0))
        for begin in range(0, len(some), 1 << 16):
            part = some[begin : begin + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], names=["bucket", "clean", "toxic"])

    none = np.full(1 << BITS, -1, np.int32)
    if not sizes.get(0) or not sizes.get(1):
        return Model(none, np.zeros(1), 30.0 if sizes.get(1) else -60.0)
    sample = materialize(labelled.select("text", "label"), "toxicity-sample")
    taken = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = sample.mapInArrow(count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = float(taken.get(0, 1)), float(taken.get(1, 1))
    # chi-square of presence against label: which features are kept
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    apart = a * (n0 - b) - b * (n1 - a)
    both = a + b
    chi = apart * apart / (both * (F.lit(n0 + n1) - both) + 1)
    kept = sums.filter(both >= 3).orderBy(chi.desc(), "bucket").limit(features).toPandas()
    if not len(kept):
        return Model(none, np.zeros(1), 0.0)
    slot = none.copy()
    slot[kept.bucket.to_numpy()] = np.arange(len(kept))
    p, q = kept.toxic.to_numpy() + SMOOTHING, kept.clean.to_numpy() + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            packed = [b""] * batch.num_rows
            for row, found in present(batch.column(0), slot):
                packed[row] = found.astype(np.int16 if features <= 1 << 15 else np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(packed, pa.binary())], names=["label", "found"])

    got = sample.mapInArrow(select, "label int, found binary").toPandas().sort_values(["label", "found"])
    parts = [np.frombuffer(x, np.int16 if features <= 1 << 15 else np.int32) for x in got.found]
    rows = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    weight, bias = fit_logistic(rows, np.concatenate(parts).astype(np.int64), got.label.to_numpy(), ratio)
    return Model(slot, weight, bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, 0 to 1; a narrow pass over whole texts."""
    names = [c for c in docs.columns if c.lower() != out.lower()]
    schema = docs.select(*names).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for row, found in present(batch.column(names.index(text)), model.slot):
                total[row] = model.weight[found].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(total))], names=[*names, out])

    return docs.select(*names).mapInArrow(run, schema)


def labelled_documents(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """``(id, text, label)`` of a bounded sample of labelled rows with an id whose remainder is not 1,
    and how many rows of each label there are.

    The sample is drawn from the narrow label table, so only its ids, at most about
    ``2 * per_label`` of them, are broadcast to the scan of the texts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & (remainder("doc_id", 3) != 1))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_label / n))).otherwise(share)
    drawn = known.filter(draw < share)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return texts.join(F.broadcast(drawn), "id"), sizes


def op3_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = train(*labelled_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    rows = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    scored = score(rows, model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
