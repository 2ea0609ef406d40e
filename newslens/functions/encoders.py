"""Text encoders that run inside tasks: ``list[str] -> float matrix``, one row per text."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from newslens.functions.hashing import TokenDigests

Encoder = Callable[[list[str]], np.ndarray]
# Fixed value: size of the hashed vector space.
HASH_DIM = 512


class HashEncoder:
    """Token counts by md5 bucket, L2-normalised; an empty text is the zero vector.

    The bucket is the low nine bits of md5, so vectors agree across workers,
    runs and engines.
    """

    dim = HASH_DIM

    def __init__(self) -> None:
        self._digests = TokenDigests()

    def entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, bucket and value of every component that is not zero, in this order."""
        tokens = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        low = self._digests(list(chain.from_iterable(tokens)))
        bucket = (low[:, 6].astype(np.int64) & 1) * 256 + low[:, 7]
        places = np.sort(np.repeat(np.arange(len(texts)) * self.dim, sizes) + bucket)
        first = np.flatnonzero(np.diff(places, prepend=-1))
        counts = np.diff(first, append=len(places)).astype(np.float64)
        text, bucket = np.divmod(places[first], self.dim)
        norm = np.sqrt(np.bincount(text, counts * counts, len(texts)))
        return text, bucket, counts / (norm[text] + 1e-12)

    def __call__(self, texts: list[str]) -> np.ndarray:
        text, bucket, value = self.entries(texts)
        out = np.zeros((len(texts), self.dim))
        out[text, bucket] = value
        return out


def hash_encoder() -> Encoder:
    return HashEncoder()


def pick_encoder(backend: str = "hash", model: Callable[[], Encoder] | None = None) -> Callable[[], Encoder]:
    """Encoder factory, called once per task.

    ``hash`` never loads a model; ``st`` needs one and lets its errors surface;
    ``auto`` decides here, before any task runs: the model if it can be loaded, the hash otherwise.
    A task that later fails to load the chosen model fails, so one table never mixes two spaces.
    """
    if backend == "hash":
        return hash_encoder
    if backend not in ("st", "auto"):
        raise ValueError(f"unknown embedding backend: {backend}")
    if model is None:
        if backend == "st":
            raise ValueError("backend 'st' needs a model factory")
        return hash_encoder
    if backend == "st":
        return model

    try:
        model()
    except Exception:
        return hash_encoder
    return model
