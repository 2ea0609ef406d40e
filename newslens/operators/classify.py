"""Transparent classifiers on calibrated features. Every one is a weight vector."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KINDS = ("linear_svm", "logreg", "rbf_svm")
FOURIER_SIZE = 256
MAX_PASSES, TOLERANCE = 50, 1e-8


def fourier_map(inputs: int, gamma: float, seed: int, size: int = FOURIER_SIZE) -> Callable[[np.ndarray], np.ndarray]:
    """Random map whose inner products approximate exp(-gamma |x - y|^2) (Rahimi and Recht, 2007)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (inputs, size))
    shift = rng.uniform(0.0, 2.0 * np.pi, size)
    return lambda x: np.sqrt(2.0 / size) * np.cos(x @ w + shift)


@dataclass(frozen=True)
class Classifier:
    """Weights, intercept and what is needed to score a frame."""

    kind: str
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    gamma: float = 0.5
    seed: int = 13

    def margin(self) -> Column:
        if self.kind != "rbf_svm":
            terms = [F.col(c) * F.lit(w) for c, w in zip(self.features, self.weights)]
            return sum(terms, F.lit(self.intercept))
        lift = fourier_map(len(self.features), self.gamma, self.seed)
        weights, intercept = np.array(self.weights), self.intercept

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                yield pa.array(lift(x) @ weights + intercept if len(batch) else np.zeros(0))

        return F.arrow_udf(score, DoubleType())(F.array(*[F.col(c).cast("double") for c in self.features]))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``score`` (signed margin) and ``pred``; a narrow map."""
        return df.withColumn("score", self.margin()).withColumn("pred", (F.col("score") > 0).cast("int"))

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(json.dumps(asdict(self)),)], "value string").write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str) -> Classifier:
        facts = json.loads(SparkSession.active().read.text(path).first()[0])
        return Classifier(**{k: tuple(v) if isinstance(v, list) else v for k, v in facts.items()})


def _squared_hinge_sums(w: np.ndarray, lift: Callable[[np.ndarray], np.ndarray] | None):
    """Per task: loss, gradient and Hessian of the squared hinge at ``w``, as (pos, v) rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(w)
        upper = np.triu_indices(d)
        loss, grad, hess = 0.0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            *xs, y = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns)
            x = np.column_stack(xs)
            x = np.column_stack([x if lift is None else lift(x), np.ones(len(x))])
            sign = 2.0 * y - 1.0
            slack = 1.0 - sign * (x @ w)
            x, slack, sign = x[slack > 0], slack[slack > 0], sign[slack > 0]
            loss += float(slack @ slack)
            grad -= 2.0 * x.T @ (sign * slack)
            hess += 2.0 * x.T @ x
        values = np.concatenate([[loss], grad, hess[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["pos", "v"])

    return sums


def _fit_squared_hinge(rows: DataFrame, inputs: int, C: float, lift) -> np.ndarray:
    """Minimise |w|^2 / 2 + C * sum max(0, 1 - y x w)^2 by Newton steps, bias included in w.

    Every pass over the data is one aggregate of a few numbers per task (at
    most 257 x 257), and a handful of passes suffice.
    """
    d = (inputs if lift is None else FOURIER_SIZE) + 1
    upper = np.triu_indices(d)

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = rows.mapInArrow(_squared_hinge_sums(w, lift), "pos int, v double")
        total = np.zeros(1 + d + len(upper[0]))
        for r in parts.groupBy("pos").agg(F.sum("v").alias("v")).toArrow().to_pylist():
            total[r["pos"]] = r["v"]
        half = np.zeros((d, d))
        half[upper] = total[1 + d :]
        hess = half + half.T - np.diag(np.diag(half))
        return w @ w / 2 + C * total[0], w + C * total[1 : 1 + d], np.eye(d) + C * hess

    w = np.zeros(d)
    value, grad, hess = evaluate(w)
    first = np.linalg.norm(grad)
    step, direction = 1.0, -np.linalg.solve(hess, grad)
    for _ in range(MAX_PASSES):
        if np.linalg.norm(grad) <= TOLERANCE * max(1.0, first):
            break
        trial = w + step * direction
        found = evaluate(trial)
        if found[0] > value + 1e-12 * abs(value):
            step /= 2
            continue
        w, (value, grad, hess) = trial, found
        step, direction = 1.0, -np.linalg.solve(hess, grad)
    return w


def _fit_logistic(train: DataFrame, features: tuple[str, ...], C: float) -> tuple[np.ndarray, float]:
    """MLlib logistic regression; C becomes its mean-loss scale, regParam = 1 / (C n)."""
    n = train.count()
    learner = LogisticRegression(
        featuresCol="_x", labelCol="_y", maxIter=1000, regParam=1.0 / (C * max(1, n)), standardization=False
    )
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train)
    model = learner.fit(ready.select("_x", "_y"))
    return model.coefficients.toArray(), float(model.intercept)


def fit_classifier(
    train: DataFrame,
    features: tuple[str, ...],
    kind: str = "linear_svm",
    C: float = 1.0,
    gamma: float = 0.5,
    label: str = "label",
    seed: int = 13,
) -> Classifier:
    """Fit on calibrated columns; the label is 0/1. ``rbf_svm`` approximates its kernel by random features."""
    kind = str(kind).lower()
    if kind not in KINDS:
        raise ValueError(f"unsupported classifier type: {kind}")
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"))
    if kind == "logreg":
        weights, intercept = _fit_logistic(rows, features, C)
    else:
        lift = fourier_map(len(features), gamma, seed) if kind == "rbf_svm" else None
        *weights, intercept = _fit_squared_hinge(rows, len(features), C, lift)
    return Classifier(kind, tuple(features), tuple(float(w) for w in weights), float(intercept), gamma, seed)
