"""BPE encoding and decoding by a pair occurrence index.

Per Arrow batch, the pre-tokens a worker has not met are laid out as one array of symbols with
links to their neighbours. An index maps the rank of each pair to all its positions. Active ranks
are applied in ascending order, each to all its positions from left to right; a merge enters the
two pairs it creates into the lists of their ranks. Pre-tokens are independent of each other, so
the common order gives each of them its own merges in its own order.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens
inside a text get their ids; ids outside the vocabulary, and null ids, decode to nothing; bytes that are no valid
UTF-8 decode to U+FFFD, as the tokenizers library does. Rows are independent, so repeated rows
give repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.pretokens import Chunk, PieceTable, Vocabulary, chunks, flat_gather, vocabulary_of, worker_state

OWNER = "bpe_pairs"


def merge_by_pairs(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbol counts and symbols of all pieces after every merge that applies."""
    merges, byte_ids, specials = vocabulary.merges, vocabulary.byte_ids, vocabulary.specials
    symbols: list[int] = []
    ends: list[int] = []
    after: list[int] = []  # next position; -1 at the end of a piece
    for piece in pieces:
        if piece in specials:
            symbols.append(specials[piece])
            after.append(-1)
        else:
            at = len(symbols)
            symbols.extend([byte_ids[b] for b in piece])
            after.extend(range(at + 1, at + len(piece)))
            after.append(-1)
        ends.append(len(symbols))
    before = [-1] * len(symbols)
    found: dict[int, list[int]] = {}
    rules: dict[int, tuple[int, int, int]] = {}
    for i, j in enumerate(after):
        if j >= 0:
            before[j] = i
            pair = symbols[i], symbols[j]
            if (merge := merges.get(pair)) is not None:
                rank, new = merge
                if rank in found:
                    found[rank].append(i)
                else:
                    found[rank] = [i]
                    rules[rank] = *pair, new
    active = list(found)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, new = rules[rank]
        for i in sorted(found.pop(rank)):
            j = after[i]
            # the list is updated lazily: a position counts only while it still holds the pair
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            k = after[j]
            symbols[i], symbols[j], after[i] = new, -1, k
            if k >= 0:
                before[k] = i
                pair = new, symbols[k]
                if (merge := merges.get(pair)) is not None:
                    r = merge[0]
                    if r in found:
                        found[r].append(i)
                    else:
                        found[r] = [i]
                        rules[r] = *pair, merge[1]
                        heapq.heappush(active, r)
            h = before[i]
            if h >= 0:
                pair = symbols[h], new
                if (merge := merges.get(pair)) is not None:
                    r = merge[0]
                    if r in found:
                        found[r].append(h)
                    else:
                        found[r] = [h]
                        rules[r] = *pair, merge[1]
                        heapq.heappush(active, r)
    flat = np.array(symbols, np.int64)
    kept = flat >= 0
    total = np.concatenate([[0], np.cumsum(kept)])
    return np.diff(total[np.concatenate([[0], ends]).astype(np.int64)]), flat[kept]


def piece_table(vocab: str) -> PieceTable:
    def make() -> PieceTable:
        vocabulary = vocabulary_of(OWNER, vocab)
        return PieceTable(vocabulary, lambda pieces: merge_by_pairs(pieces, vocabulary))

    return worker_state(OWNER, ("pieces", vocab), make)


def ids_per_text(table: PieceTable, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunk's texts, one after the other, and how many each text has."""
    entries, first = table.tokens(chunk)
    ids, counts = table.ids(entries)
    before = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(before[np.append(first, len(entries))])


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoder(vocab: str, text: str, out: str) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(vocab)
        for batch in batches:
            lengths, parts = np.zeros(batch.num_rows, np.int64), []
            for chunk in chunks(batch.column(batch.schema.get_field_index(text))):
                ids, counts = ids_per_text(table, chunk)
                parts.append(ids.astype(np.int32))
                np.add.at(lengths, chunk.rows, counts)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return run


def _bytes_of(ids: np.ndarray, vocab: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of many ids, and where those of each id end."""

    def make() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every = vocabulary_of(OWNER, vocab).token_bytes
        lengths = np.array([len(x) for x in every], np.int64)
        return np.frombuffer(b"".join(every), np.uint8), np.cumsum(lengths) - lengths, lengths

    pool, offsets, lengths = worker_state(OWNER, ("token_bytes", vocab), make)
    ids = np.where((ids >= 0) & (ids < len(lengths)), ids, len(lengths))
    lengths, offsets = np.append(lengths, 0), np.append(offsets, 0)
    return flat_gather(pool, offsets, lengths, ids), np.cumsum(lengths[ids])


def _decoder(vocab: str, ids: str, out: str) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = []
            flat, step = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False), 1 << 18
            lengths = np.diff(np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]))
            ends = np.cumsum(lengths)
            row = 0
            while row < len(lengths):  # some rows at a time, so that memory stays bounded
                begin = int(ends[row] - lengths[row])
                last = max(row + 1, int(np.searchsorted(ends, begin + step, "right")))
                blob, token_ends = _bytes_of(flat[begin : int(ends[last - 1])], vocab)
                cut = np.concatenate([[0], token_ends])[np.concatenate([[0], ends[row:last] - begin])].tolist()
                raw = blob.tobytes()
                texts.extend(raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:]))
                row = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return run


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False), False)


def _mapped(docs: DataFrame, run: Batches, *added: T.StructField) -> DataFrame:
    """One narrow pass; columns of ``docs`` that an added one would clash with go."""
    taken = {f.name.lower() for f in added}
    rows = docs.select(*[c for c in docs.columns if c.lower() not in taken])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def encode(docs: DataFrame, vocab: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of each whole text as ``array<int>``."""
    return _mapped(docs, _encoder(vocab, text, out), _ids_field(out))


def decode(docs: DataFrame, vocab: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of each ``array<int>`` of ids, special tokens included."""
    return _mapped(docs, _decoder(vocab, ids, out), T.StructField(out, T.StringType(), False))


def encode_and_decode(docs: DataFrame, vocab: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Both columns by one Python worker a task; :func:`encode` and :func:`decode` in a row would run two."""
    first, second = _encoder(vocab, text, ids), _decoder(vocab, ids, out)
    return _mapped(docs, lambda batches: second(first(batches)), _ids_field(ids), T.StructField(out, T.StringType(), False))


def _decimal_table(size: int) -> np.ndarray:
    """Each number with a comma, left-justified in 8 bytes, as one 64-bit word."""
    return np.frombuffer(b"".join(f"{i},".encode().ljust(8, b"\0") for i in range(size)), np.uint64)


def round_trip_digests(docs: DataFrame, vocab: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, decode, and digest both per text.

    The same encoder and decoder as above, in one pass and without ids or texts leaving the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(vocab)
        decimal = worker_state(OWNER, ("decimals", vocab), lambda: _decimal_table(table.vocabulary.size))
        for batch in batches:
            n = batch.num_rows
            totals = np.zeros(n, np.int64)
            of_ids, of_text = [sha256().hexdigest()] * n, [sha256().hexdigest()] * n
            open_row, ids_hash, text_hash = -1, sha256(), sha256()
            for chunk in chunks(batch.column(1)):
                ids, counts = ids_per_text(table, chunk)
                slots = decimal[ids].view(np.uint8)
                width = (slots != 0).reshape(-1, 8).sum(axis=1)
                written = slots[slots != 0].tobytes()
                blob, token_ends = _bytes_of(ids, vocab)
                raw = blob.tobytes()
                at = np.concatenate([[0], np.cumsum(counts)])
                text_cut = np.concatenate([[0], token_ends])[at].tolist()
                id_cut = np.concatenate([[0], np.cumsum(width)])[at].tolist()
                for k, row in enumerate(chunk.rows.tolist()):
                    if row != open_row:  # the first part of a text
                        open_row, ids_hash, text_hash = row, sha256(), sha256()
                        ids_hash.update(written[id_cut[k] : id_cut[k + 1] - 1])
                    elif counts[k]:
                        ids_hash.update(b"," + written[id_cut[k] : id_cut[k + 1] - 1])
                    # a part ends where a character ends, so parts decode like the whole
                    text_hash.update(raw[text_cut[k] : text_cut[k + 1]].decode("utf-8", "replace").encode())
                    totals[row] += counts[k]
                    of_ids[row], of_text[row] = ids_hash.hexdigest(), text_hash.hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals), pa.array(of_ids), pa.array(of_text)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias(text))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_query(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf}/documents.parquet"), vocabulary_path())
