"""Document space A, and the two features that need sentence vectors (PR, HS)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from newslens.config import PART_WEIGHTS
from newslens.functions.encoders import Encoder, hash_encoder
from newslens.functions.scalars import once

# Texts encoded at a time, and documents put together: bound the memory of a task at a few matrices of CHUNK x dim doubles.
CHUNK, DOCUMENTS = 1024, 256
TINY = 1e-12

VECTOR = ArrayType(FloatType())
DOCUMENT = StructType(
    [StructField("A", VECTOR), StructField("PR", DoubleType()), StructField("HS", DoubleType())]
)


def _float_lists(matrix: np.ndarray) -> pa.Array:
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(0, rows * dim + 1, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


def text_vectors(encoder: Callable[[], Encoder] = hash_encoder):
    """Column function: one vector per text."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder()
        for batch in batches:
            parts = ([t or "" for t in batch[i : i + CHUNK].to_pylist()] for i in range(0, len(batch), CHUNK))
            yield pa.concat_arrays([_float_lists(enc(texts)) for texts in parts])

    return once(F.arrow_udf(encode, VECTOR))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + TINY)


def _sums_by_owner(vec: np.ndarray, owner: np.ndarray, in_body: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: sum of the vectors in the body, sum of all unit vectors, number of vectors that are not zero."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    body, units, nonzero = np.zeros((n, vec.shape[1])), np.zeros((n, vec.shape[1])), np.zeros(n)
    body[owner[first]] = np.add.reduceat(vec * in_body[:, None], first)
    units[owner[first]] = np.add.reduceat(_unit(vec), first)
    nonzero[owner[first]] = np.add.reduceat(np.any(vec != 0, axis=1).astype(float), first)
    return body, units, nonzero


def _sums_by_entry(entries, dim: int, owner: np.ndarray, in_body: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_sums_by_owner`, from the components that are not zero: short sentences have few."""
    text, bucket, value = entries
    place = owner[text] * dim + bucket
    body = np.bincount(place, value * in_body[text], n * dim).reshape(n, dim)
    squares = np.bincount(text, value * value, len(owner))
    units = np.bincount(place, value / (np.sqrt(squares[text]) + TINY), n * dim).reshape(n, dim)
    return body, units, np.bincount(owner[squares > 0], minlength=n).astype(float)


def _sentence_sums(enc: Encoder, sents: pa.ListArray, limit: int):
    """Per document: mean vector of the first ``limit`` sentences, and mean pairwise cosine of all.

    With unit vectors u the pair sum is (|sum u|^2 - number of non-zero u) / 2,
    so the cost is linear in the number of sentences. An encoder with ``entries`` gives only components that are not zero.
    """
    offsets = sents.offsets.to_numpy() - sents.offsets[0].as_py()
    flat = sents.flatten()
    counts = np.diff(offsets)
    sparse = hasattr(enc, "entries")
    nothing = enc([""])[0]
    body, units, nonzero = np.zeros((len(counts), len(nothing))), np.zeros((len(counts), len(nothing))), np.zeros(len(counts))
    for start in range(0, len(flat), CHUNK):
        chunk = [s or "" for s in flat[start : start + CHUNK].to_pylist()]
        at = np.arange(start, start + len(chunk))
        owner = np.searchsorted(offsets, at, side="right") - 1
        in_body = (at - offsets[owner]) < limit
        low, n = owner[0], owner[-1] - owner[0] + 1
        if sparse:
            sums = _sums_by_entry(enc.entries(chunk), enc.dim, owner - low, in_body, n)
        else:
            sums = _sums_by_owner(enc(chunk), owner - low, in_body, n)
        for total, part in zip((body, units, nonzero), sums):
            total[low : low + n] += part
    body[counts == 0] = nothing
    mean = body / np.maximum(1, np.minimum(counts, limit))[:, None]
    pairs = counts * (counts - 1.0)
    total = (units**2).sum(axis=1) - nonzero
    similarity = np.divide(total, pairs, out=np.zeros_like(total), where=pairs > 0)
    return mean, np.clip(similarity, 0.0, 1.0)


def document_vectors(
    encoder: Callable[[], Encoder] = hash_encoder,
    weights: tuple[float, float, float] = PART_WEIGHTS,
    max_body_sentences: int = 80,
    others: Sequence[tuple[float, float, float]] = (),
):
    """Column function of (title, lead, sentences) giving ``struct<A, PR, HS>``, and ``A0, A1, ...`` for ``others``, further weights.

    Every sentence is encoded once and serves the body mean, for all weights, and PR.
    """
    names = ["A", "PR", "HS", *[f"A{k}" for k in range(len(others))]]

    def encode(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        enc = encoder()
        for title, lead, sents in batches:
            done = []
            for i in range(0, len(title), DOCUMENTS):
                t, l = (enc([x or "" for x in part[i : i + DOCUMENTS].to_pylist()]) for part in (title, lead))
                mean, similarity = _sentence_sums(enc, sents[i : i + DOCUMENTS], max_body_sentences)
                coherence = np.clip(
                    (t * l).sum(axis=1) / (np.linalg.norm(t, axis=1) * np.linalg.norm(l, axis=1) + TINY), 0.0, 1.0
                )
                a, *more = (_float_lists(_unit(w[0] * t + w[1] * l + w[2] * mean)) for w in (weights, *others))
                done.append(pa.StructArray.from_arrays([a, pa.array(similarity), pa.array(coherence), *more], names=names))
            yield pa.concat_arrays(done)

    return once(F.arrow_udf(encode, StructType([*DOCUMENT, *[StructField(n, VECTOR) for n in names[3:]]])))


def with_document_vectors(df: DataFrame, title: str, lead: str, sents: str, **options) -> DataFrame:
    """Add A, PR and HS, and A0, A1, ... for ``others``; a narrow map over Arrow batches."""
    vec = document_vectors(**options)
    names = ["A", "PR", "HS", *[f"A{k}" for k in range(len(options.get("others", ())))]]
    return (
        df.withColumn("_v", vec(F.coalesce(title, F.lit("")), F.coalesce(lead, F.lit("")), F.col(sents)))
        .withColumns({n: F.col(f"_v.{n}") for n in names})
        .drop("_v")
    )
