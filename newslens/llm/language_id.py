"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary linear classifier over hashed byte
n-grams (regularised least squares) predicts -1 or 1; the language whose codeword loses least
wins. The loss of a bit counts by how well that bit's classifier separated that language in
training (loss-weighted decoding), so unreliable bits cannot outvote reliable ones.

The classifiers are fitted on at most ``per_language`` labelled texts of each language, chosen by
a hash of the id among all; the counts behind that choice and the predictions cover all rows.

Defined results: ``und`` with score 0 for a null text and for one without a letter, or if there
are no labelled rows at all; with one known language that language is predicted. Null ids and null
languages are never learned from. Repeated rows get repeated results; languages beyond
``max_languages``, which bounds what is broadcast, are rejected with an error rather than dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.columns import free_name
from newslens.llm.ngrams import LETTERS, hashed_ngrams
from newslens.llm.pretokens import forget

OWNER = "language_id"
ORDERS = (1, 2, 3, 4)
BITS = 13
PER_LANGUAGE = 400
MAX_LANGUAGES = 1000
RIDGE = 0.1
SHARPNESS = 6.0
AMBIGUOUS = 0.6
UNKNOWN = "und"


def codewords(classes: int) -> np.ndarray:
    """One row of -1 and 1 per class.

    Up to six classes get the exhaustive code (every split of the classes once); more get random
    rows of about 10 log2(classes) bits, of several draws the one whose closest rows differ most.
    """
    if classes == 1:
        return np.ones((1, 1))
    if classes <= 6:
        splits = np.arange(1, 1 << (classes - 1))
        return np.array([[1.0 if not c or s >> (c - 1) & 1 ^ 1 else -1.0 for s in splits] for c in range(classes)])
    rng, bits = np.random.default_rng(7), ceil(10 * log2(classes))
    best, widest = None, -1
    for _ in range(20):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]  # a bit needs both sides
        closest = ((code.shape[1] - code @ code.T) / 2 + np.eye(classes) * bits).min()
        if closest > widest:
            best, widest = code, closest
    return best


def histograms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their n-gram counts, some rows at a time; the parts of a long text are already added."""
    size, step = 1 << BITS, 128
    open_row, held = -1, None
    for rows, of, buckets in hashed_ngrams(texts, ORDERS, BITS, LETTERS):
        if held is not None and rows[0] != open_row:
            yield np.array([open_row]), held
            held = None
        if len(rows) == 1:  # maybe a part of a long text
            counts = np.bincount(buckets, minlength=size).astype(np.float32)[None]
            held = counts if held is None else held + counts
            open_row = rows[0]
            continue
        order = np.argsort(of, kind="stable")
        of, buckets = of[order], buckets[order]
        cuts = np.searchsorted(of, np.arange(0, len(rows) + step, step))
        for k, begin in enumerate(range(0, len(rows), step)):
            part = slice(cuts[k], cuts[k + 1])
            n = min(step, len(rows) - begin)
            flat = np.bincount((of[part] - begin).astype(np.int64) * size + buckets[part], minlength=n * size)
            yield rows[begin : begin + n], flat.reshape(n, size).astype(np.float32)
    if held is not None:
        yield np.array([open_row]), held


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares: rows of length 1."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    trust: np.ndarray  # languages x bits, rows sum to 1
    weights: np.ndarray  # buckets x bits

    def losses(self, counts: np.ndarray) -> np.ndarray:
        margin = self.code[None] * (scaled(counts) @ self.weights)[:, None, :]
        return (self.trust[None] * np.maximum(0, 1 - margin) ** 2).sum(axis=2)

    def decide(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its share of the belief."""
        loss = self.losses(counts)
        belief = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        best = loss.argmin(axis=1)
        # rounded: the order of sums in a matrix product depends on the rows beside it
        return best, np.round(belief.max(axis=1).astype(np.float64) / belief.sum(axis=1), 5)


def fit(features: np.ndarray, labels: np.ndarray, languages: list[str]) -> Model:
    """One least-squares classifier per bit; all bits share the factorised Gram matrix."""
    code = codewords(len(languages))
    x = scaled(features)
    target = code[labels]
    gram = (x @ x.T).astype(np.float64)
    weights = x.T @ np.linalg.solve(gram + RIDGE * np.eye(len(x)), target).astype(np.float32)
    right = (x @ weights) * target
    trust = np.array([np.maximum((right[labels == c] > 0).mean(axis=0) - 0.5, 0.01) for c in range(len(languages))])
    return Model(languages, code, trust / trust.sum(axis=1, keepdims=True), weights.astype(np.float32))


def training_sample(labelled: DataFrame, per_language: int, max_languages: int) -> DataFrame:
    """About ``per_language`` rows of each language: a share of each, by the hash of the id.

    ``labelled`` has ``id, text, lang``; the counts of languages are few and checked.
    """
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return labelled.limit(0)
    spark = labelled.sparkSession
    share = spark.createDataFrame([(r.lang, min(1.0, per_language / r.n)) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    return labelled.join(F.broadcast(share), "lang").filter(draw < F.col("share")).drop("share")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """Fit on the sample; its n-gram counts are made in the tasks and come as one short row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        for batch in batches:
            languages = batch.column(1)
            for rows, counts in histograms(batch.column(0)):
                packed = [c.astype(np.float32).tobytes() for c in counts]
                yield pa.RecordBatch.from_arrays([languages.take(pa.array(rows)), pa.array(packed, pa.binary())], names=["lang", "counts"])

    sample = training_sample(labelled, per_language, max_languages).select("text", "lang")
    got = sample.mapInArrow(run, "lang string, counts binary").toArrow()
    if not got.num_rows:
        return None
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    features = np.stack([np.frombuffer(c, np.float32) for c in got.column("counts").to_pylist()])
    at = {lang: i for i, lang in enumerate(languages)}
    order = np.lexsort((features.sum(axis=1), np.array([at[x] for x in names])))  # the same sums whatever the task order
    return fit(features[order], np.array([at[x] for x in names])[order], languages)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous`` (the nearest codeword is not clearly nearest)."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    added = "lang_pred string, score double, ambiguous boolean"
    with_text = docs.select(*names, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(free_name(docs, "_letters")))
    schema = docs.select(*names).schema
    for field in added.split(", "):
        schema = schema.add(*field.split(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        for batch in batches:
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            letters = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            if model is not None:
                for rows, counts in histograms(batch.column(names.index(text))):
                    best[rows], score[rows] = model.decide(counts)
            else:
                letters[:] = False
            score[~letters] = 0.0
            known = np.array([*(model.languages if model else []), UNKNOWN], object)
            picked = known[np.where(letters, best, len(known) - 1)]
            columns = [pa.array(picked, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, "lang_pred", "score", "ambiguous"])

    return with_text.mapInArrow(run, schema)


def remainder(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of))


def op1_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    learned = docs.filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = train(learned.select(F.col("doc_id").alias("id"), "text", "lang"))
    rows = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
