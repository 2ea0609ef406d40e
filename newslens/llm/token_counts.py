"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted.

The symbols of a pre-token form a linked list; a heap holds its adjacent pairs by rank and place.
The lowest pair is popped and merged again and again, stale entries are skipped, and the count is
the number of initial symbols minus the number of merges.

Defined results: null and empty texts count 0 bytes and 0 tokens; a special token inside a text
counts as one. Rows are independent of each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.bpe_pairs import vocabulary_path
from newslens.llm.pretokens import PieceTable, Vocabulary, chunks, vocabulary_of, worker_state

OWNER = "token_counts"


def merges_in(piece: bytes, vocabulary: Vocabulary) -> int:
    """How many merges apply to one pre-token."""
    merges = vocabulary.merges
    symbols = [vocabulary.byte_ids[b] for b in piece]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (merge := merges.get((symbols[i], symbols[i + 1]))) is not None:
            heap.append((merge[0], i, symbols[i], symbols[i + 1], merge[1]))
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two was merged meanwhile
        done += 1
        k = after[j]
        symbols[i], symbols[j], after[i] = new, -1, k
        if k < n:
            before[k] = i
            if (merge := merges.get((new, symbols[k]))) is not None:
                heapq.heappush(heap, (merge[0], i, new, symbols[k], merge[1]))
        h = before[i]
        if h >= 0 and (merge := merges.get((symbols[h], new))) is not None:
            heapq.heappush(heap, (merge[0], h, symbols[h], new, merge[1]))
    return done


def counted(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, None]:
    return np.array([1 if p in vocabulary.specials else len(p) - merges_in(p, vocabulary) for p in pieces], np.int64), None


def token_counts(docs: DataFrame, vocab: str, id_col: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each whole text, one narrow pass."""

    def make() -> PieceTable:
        vocabulary = vocabulary_of(OWNER, vocab)
        return PieceTable(vocabulary, lambda pieces: counted(pieces, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_state(OWNER, ("pieces", vocab), make)
        for batch in batches:
            n_bytes, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for chunk in chunks(batch.column(1)):
                entries, first = table.tokens(chunk)
                np.add.at(n_tokens, chunk.rows, np.add.reduceat(table.counts[entries].astype(np.int64), first))
                np.add.at(n_bytes, chunk.rows, np.diff(np.append(chunk.borders, len(chunk.data))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias(text))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op7_query(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf}/documents.parquet"), vocabulary_path())
