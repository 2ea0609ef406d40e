"""Hashed n-grams of UTF-8 bytes for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from newslens.llm.pretokens import chunks


def _byte_map(keep_other: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if not keep_other:  # everything in ASCII that is no letter separates words
        table[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
    return table


LETTERS, CHARACTERS = _byte_map(False), _byte_map(True)


def hashed_ngrams(
    texts: pa.Array, orders: tuple[int, ...], bits: int, byte_map: np.ndarray, chunk_bytes: int = 1 << 19
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: the rows it holds, and for each n-gram its text (index into those rows) and its bucket.

    A text longer than a chunk comes in several chunks, cut between two words at places that depend
    on that text alone. An n-gram never crosses two texts. ASCII letters are lower-cased.
    """
    for chunk in chunks(texts, chunk_bytes):
        data = byte_map[chunk.data].astype(np.uint64)
        lengths = np.diff(np.append(chunk.borders, len(data)))
        owner = np.repeat(np.arange(len(chunk.rows), dtype=np.int32), lengths)
        of, buckets = [], []
        for n in orders:
            if len(data) < n:
                continue
            code = data[: len(data) - n + 1].copy()
            for k in range(1, n):
                code |= data[k : len(data) - n + 1 + k] << np.uint64(8 * k)
            code += np.uint64(n) << np.uint64(56)
            code *= np.uint64(0x9E3779B97F4A7C15)
            bucket = (code >> np.uint64(64 - bits)).astype(np.int32)
            whole = owner[: len(bucket)] == owner[n - 1 :]
            of.append(owner[: len(bucket)][whole])
            buckets.append(bucket[whole])
        empty = np.zeros(0, np.int32)
        yield chunk.rows, np.concatenate([*of, empty]), np.concatenate([*buckets, empty])
