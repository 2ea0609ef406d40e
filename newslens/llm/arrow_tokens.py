"""Token ids in Arrow IPC files: fixed-size lists of ids and masks, readable in place.

Documents are ordered by id with a range shuffle, so that the files of partition p hold smaller
ids than those of p + 1. Each task encodes its documents, appends the end id to each, and packs
them into rows of ``sequence`` ids; a file is closed, and its last row padded, at the first
document end beyond ``file_ids`` ids, so no document lies in two files. Columns of a file:

* ``ids``: fixed-size list, 16-bit if the vocabulary allows it, otherwise 32-bit,
* ``mask``: fixed-size list of booleans, false on padding,
* ``documents``: ``(id, at, n)`` of the documents that begin in the row; ``n`` ids from place
  ``at`` on, over as many rows as they need.

The footer of the file format gives random access: row i is a slice of the mapped file, nothing
is copied or decoded. Files get unique names and count only if the manifest lists them; the
manifest is a table that Spark commits, so a task that is run again or twice does no harm.

Defined results: null and empty texts are the end id alone; rows with the same id are kept side by
side, ordered by a hash of their texts; a null id comes first; an empty table gives an empty manifest.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.bpe_pairs import vocabulary_path
from newslens.llm.pretokens import PieceTable, Vocabulary, chunks, vocabulary_of, worker_state
from newslens.runtime import scratch_path

OWNER = "arrow_tokens"
SEQUENCE = 2048
FILE_IDS = 1 << 23
ROWS_PER_BATCH = 256
DOCUMENTS = pa.list_(pa.struct([("id", pa.int64()), ("at", pa.int32()), ("n", pa.int64())]))
MANIFEST = "part int, file int, path string, n_ids bigint, n_documents bigint"


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder: a plain path, ``file:``, or any scheme pyarrow opens."""
    folder = re.sub(r"^file:/+", "/", folder)
    return (pafs.LocalFileSystem(), folder) if folder.startswith("/") else pafs.FileSystem.from_uri(folder)


def by_library(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens from the tokenizers library: one call, special tokens hold the pieces apart."""
    if not vocabulary.specials:
        every = [e.ids for e in vocabulary.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([len(x) for x in every], np.int64), np.array([i for x in every for i in x], np.uint32)
    name, border = next(iter(vocabulary.specials.items()))
    plain = [b"" if p in vocabulary.specials else p for p in pieces]
    got = np.array(vocabulary.tokenizer.encode((name + name.join(plain) + name).decode(), add_special_tokens=False).ids, np.uint32)
    at = np.flatnonzero(got == border)
    counts = np.diff(at) - 1
    own = [(i, vocabulary.specials[p]) for i, p in enumerate(pieces) if p in vocabulary.specials]
    ids = got[got != border]
    if own:
        where = (np.cumsum(counts) - counts)[[i for i, _ in own]]
        ids = np.insert(ids, where, [x for _, x in own])
        counts[[i for i, _ in own]] = 1
    return counts, ids


class FileWriter:
    """Packs documents of one task into files."""

    def __init__(self, folder: str, kind: np.dtype, sequence: int, file_ids: int):
        self.folder, self.kind, self.sequence, self.file_ids = folder, kind, sequence, file_ids
        self.parts: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.filled, self.number = 0, 0
        self.written: list[tuple[int, str, int, int]] = []

    def add(self, ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Documents with their lengths and all their ids in order."""
        while len(lengths):
            ends = np.cumsum(lengths)
            n = min(len(lengths), 1 + int(np.searchsorted(ends, self.file_ids - self.filled)))
            taken = int(ends[n - 1])
            self.ids.append(ids[:n])
            self.lengths.append(lengths[:n])
            self.parts.append(flat[:taken])
            self.filled += taken
            ids, lengths, flat = ids[n:], lengths[n:], flat[taken:]
            if self.filled >= self.file_ids:
                self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        flat, lengths = np.concatenate(self.parts), np.concatenate(self.lengths)
        doc_ids = pa.concat_arrays([pa.array(x, pa.int64(), from_pandas=True) for x in self.ids])
        rows = -(-len(flat) // self.sequence)
        padded = np.zeros(rows * self.sequence, self.kind)
        padded[: len(flat)] = flat
        mask = np.zeros(rows * self.sequence, bool)
        mask[: len(flat)] = True
        begins = np.cumsum(lengths) - lengths
        row, at = begins // self.sequence, begins % self.sequence
        offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays(
            [doc_ids, pa.array(at.astype(np.int32)), pa.array(lengths)], fields=list(DOCUMENTS.value_type)
        )
        table = pa.table(
            {
                "ids": pa.FixedSizeListArray.from_arrays(pa.array(padded), self.sequence),
                "mask": pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence),
                "documents": pa.ListArray.from_arrays(pa.array(offsets), entries),
            }
        )
        store, root = open_folder(self.folder)
        path = f"{root}/{uuid.uuid4().hex}.arrow"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(path) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table, max_chunksize=ROWS_PER_BATCH)
        self.written.append((self.number, f"{self.folder.rstrip('/')}/{path.rsplit('/', 1)[1]}", len(flat), len(lengths)))
        self.number += 1
        self.parts, self.ids, self.lengths, self.filled = [], [], [], 0


def library_table(vocab: str) -> PieceTable:
    def make() -> PieceTable:
        vocabulary = vocabulary_of(OWNER, vocab)
        return PieceTable(vocabulary, lambda pieces: by_library(pieces, vocabulary))

    return worker_state(OWNER, ("pieces", vocab), make)


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocab: str,
    end_id: int,
    id_col: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the files; returns the stored manifest ``(part, file, path, n_ids, n_documents)``.

    ``folder`` must be one that all executors and pyarrow can open.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocab)
        kind = np.dtype(np.uint16 if max(table.vocabulary.size, end_id + 1) <= 1 << 16 else np.uint32)
        writer = FileWriter(f"{folder.rstrip('/')}/files", kind, sequence, file_ids)
        for batch in batches:
            lengths = np.zeros(batch.num_rows, np.int64)
            parts = []
            for chunk in chunks(batch.column(1)):
                entries, first = table.tokens(chunk)
                ids, counts = table.ids(entries)
                parts.append(ids.astype(kind))
                before = np.concatenate([[0], np.cumsum(counts)])
                np.add.at(lengths, chunk.rows, np.diff(before[np.append(first, len(entries))]))
            lengths += 1
            flat = np.full(int(lengths.sum()), end_id, kind)
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(lengths) - 1] = False
            flat[inner] = np.concatenate([*parts, np.zeros(0, kind)])
            writer.add(batch.column(0).to_numpy(zero_copy_only=False), lengths, flat)
        writer.flush()
        part = TaskContext.get().partitionId()
        rows = [(part, *x) for x in writer.written]
        columns = [list(c) for c in zip(*rows)] or [[] for _ in range(5)]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "file", "path", "n_ids", "n_documents"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """Reader over the mapped file, or over the store's random access where nothing can be mapped."""
    store, name = open_folder(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(name))


def sequence_at(reader: pa.ipc.RecordBatchFileReader, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one row: the ids are a view on the file, the mask is unpacked from its bits."""
    batch = reader.get_batch(row // ROWS_PER_BATCH)
    ids, mask = batch.column("ids"), batch.column("mask")
    k, width = row % ROWS_PER_BATCH, ids.type.list_size
    return (
        ids.values.slice((ids.offset + k) * width, width).to_numpy(),
        mask.values.slice((mask.offset + k) * width, width).to_numpy(zero_copy_only=False),
    )


def read_documents(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files; start counts the ids of all documents before.

    One file per row of the manifest, spread over tasks. Offsets come from sums per part (one row per
    range partition) and per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = open_file(path)
                ids, counts, sums = [], [], []
                held, missing = [], 0  # parts of the document that is still open
                for b in range(reader.num_record_batches):
                    record = reader.get_batch(b)
                    flat = record.column("ids").flatten().to_numpy()
                    starts = record.column("documents")
                    entries = starts.flatten()
                    row = np.repeat(np.arange(len(starts)), starts.value_lengths().to_numpy())
                    width = record.column("ids").type.list_size
                    begin = row * width + entries.field("at").to_numpy()
                    length = entries.field("n").to_numpy()
                    if missing:
                        held.append(flat[:missing])
                        missing -= len(held[-1])
                        if not missing:
                            sums.append(crc32(np.concatenate(held).astype("<u4").tobytes()))
                    for s, n in zip(begin.tolist(), length.tolist()):
                        piece = flat[s : s + n]
                        if len(piece) < n:
                            held, missing = [piece], n - len(piece)
                        else:
                            sums.append(crc32(piece.astype("<u4").tobytes()))
                    ids.append(entries.field("id"))
                    counts.append(length)
                n = np.concatenate(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(ids), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", earlier(Window.orderBy("part")).alias("base"))
    placed = manifest.withColumn("inner", earlier(Window.partitionBy("part").orderBy("file"))).join(parts, "part")
    spread = placed.select("path", (F.col("base") + F.col("inner")).alias("before")).repartition("path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return read_documents(write_tokens(docs, scratch_path(spark, "arrow-tokens"), vocabulary_path(), end_id=2))
