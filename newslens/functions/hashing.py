"""Stable token hashes, the same in Spark SQL, in Python tasks and in other engines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newslens.functions.scalars import once

# Bound on the per-task token cache; it is emptied when full.
MAX_CACHED_TOKENS = 100_000


def md5_low64(text: Column) -> Column:
    """Low 64 bits of md5 as a signed BIGINT."""
    return F.conv(F.substring(F.md5(text), 17, 16), 16, -10).cast("bigint")


def order_key(*parts: Column) -> Column:
    """Uniform, portable shuffle key: hex md5 over ``part:part:...``."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def order_bucket(key: Column) -> Column:
    """First 16 bits of an :func:`order_key`: 65,536 even buckets in key order."""
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")


class _Digests(dict):
    def __missing__(self, token: str) -> bytes:
        found = self[token] = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[8:]
        return found


class TokenDigests:
    """md5 low halves of tokens, remembered within one task."""

    def __init__(self) -> None:
        self._seen = _Digests()

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self._seen) > MAX_CACHED_TOKENS:
            self._seen.clear()
        return np.frombuffer(b"".join(map(self._seen.__getitem__, tokens)), np.uint8).reshape(-1, 8)


@once
@F.arrow_udf(LongType())
def simhash64(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """64-bit SimHash over lower-cased words with multiplicity.

    A bit is set when strictly more than half of the words set it, so a tie or
    an empty text gives 0.
    """
    digests = TokenDigests()
    for batch in batches:
        signatures = np.zeros(len(batch), np.uint64)
        for row, value in enumerate(batch):
            tokens = (value.as_py() or "").lower().split()
            if tokens:
                ones = np.unpackbits(digests(tokens), axis=1).sum(axis=0, dtype=np.int64)
                signatures[row] = np.packbits(2 * ones > len(tokens)).view(">u8")[0]
        yield pa.array(signatures.view(np.int64))
