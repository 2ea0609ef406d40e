"""BPE encoding, decoding, counting and token files against the tokenizers library."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newslens.llm import arrow_tokens, bpe_pairs, pretokens, token_counts
from newslens.runtime import scratch_path

VOCAB = bpe_pairs.vocabulary_path()
END = 2


@pytest.fixture(scope="module")
def library():
    return pretokens.Vocabulary(VOCAB)


def odd_texts(n=1500):
    rng = random.Random(4)
    parts = ["'s", "'ll", "'re", "'", "''", " ", "  ", "\n", "\t", "a", "Zoo", "é", "12", "²", "Ⅳ", "中文", "　", "\x85", "!", "?!",
             "<|endoftext|>", "<|endof", "Ᲊ", "\U00011de0", "😀", "\x1c", " '", "'t", "vex", "aaaa", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


TEXTS = [*odd_texts(), None, "", " ", "word", "word", "long words and more, " * 4000, "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 7), (3, TEXTS[3], "clash", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int").repartition(5)


@pytest.fixture(scope="module")
def expected(library):
    return [e.ids for e in library.tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 700])
def test_chunks_do_not_change_ids(library, expected, chunk_bytes):
    table, got = bpe_pairs.piece_table(VOCAB), [[] for _ in TEXTS]
    for chunk in pretokens.chunks(pa.array(TEXTS, pa.string()), chunk_bytes):
        ids, counts = bpe_pairs.ids_per_text(table, chunk)
        at = 0
        for row, n in zip(chunk.rows.tolist(), counts.tolist()):
            got[row] += ids[at : at + n].tolist()
            at += n
    assert got == expected


def test_small_piece_table_starts_anew(library, expected, monkeypatch):
    monkeypatch.setattr(pretokens, "TABLE_ENTRIES", 50)
    table = pretokens.PieceTable(library, lambda pieces: bpe_pairs.merge_by_pairs(pieces, library))
    for text, ids in zip(TEXTS[:300], expected[:300]):
        got = [bpe_pairs.ids_per_text(table, c)[0].tolist() for c in pretokens.chunks(pa.array([text], pa.string()))]
        assert [i for part in got for i in part] == ids


def test_encode_and_decode(docs, expected, library):
    coded = bpe_pairs.encode(docs, VOCAB)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]  # the clashing column gives way
    rows = bpe_pairs.decode(coded, VOCAB).collect()
    assert rows == bpe_pairs.encode_and_decode(docs.withColumn("IDS", F.lit(0)), VOCAB).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.decoded == (r.text or "") and r.n_tokens == 7
        if r.doc_id is not None:
            assert r.ids == expected[r.doc_id]


def test_decode_of_strange_ids(spark, library):
    broken = library.tokenizer.encode("é", add_special_tokens=False).ids
    half = [library.byte_ids[0xC3]]
    rows = [(0, half), (1, None), (2, []), (3, [-5, 99_999_999]), (4, [50256, *broken]), (5, [None, *broken])]
    got = {r.i: r.decoded for r in bpe_pairs.decode(spark.createDataFrame(rows, "i int, ids array<int>"), VOCAB).collect()}
    assert got == {0: "�", 1: "", 2: "", 3: "", 4: "<|endoftext|>é", 5: "é"}


def test_digests(docs, expected):
    for r in bpe_pairs.round_trip_digests(docs, VOCAB).collect():
        if r.doc_id is None:
            continue
        ids, text = expected[r.doc_id], TEXTS[r.doc_id] or ""
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_counts(docs, expected):
    for r in token_counts.token_counts(docs, VOCAB).collect():
        if r.doc_id is not None:
            n = len(expected[r.doc_id])
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((TEXTS[r.doc_id] or "").encode()), n, n > 1024)


def test_token_files(spark, docs, expected):
    manifest = arrow_tokens.write_tokens(docs, scratch_path(spark, "test-files"), VOCAB, END, sequence=64, file_ids=3000)
    rows = arrow_tokens.read_documents(manifest).collect()
    order = [None, *sorted([*range(len(TEXTS)), 3])]
    ids_of = lambda i: ([] if i is None else expected[i]) + [END]
    start, want = 0, {}
    for i in order:
        n = len(ids_of(i)) if i is not None else next(r.n_tokens for r in rows if r.doc_id is None)
        want.setdefault(i, []).append((start, n))
        start += n
    assert sorted((repr(r.doc_id), r.start, r.n_tokens) for r in rows) == sorted((repr(i), *x) for i, xs in want.items() for x in xs)
    for r in rows:
        if r.doc_id is not None:
            assert r.ids_crc32 == crc32(np.array(ids_of(r.doc_id), "<u4").tobytes())


def test_random_access_is_a_view(spark, docs):
    manifest = arrow_tokens.write_tokens(docs, scratch_path(spark, "test-view"), VOCAB, END, sequence=64, file_ids=1 << 30)
    path = manifest.orderBy("n_ids", ascending=False).first().path
    reader = arrow_tokens.open_file(path)
    last = sum(reader.get_batch(b).num_rows for b in range(reader.num_record_batches)) - 1
    before = pa.total_allocated_bytes()
    ids, mask = arrow_tokens.sequence_at(reader, last)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and pa.total_allocated_bytes() <= before + 64  # the mask
    assert ids[mask][-1] == END and (ids[~mask] == 0).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe_pairs.encode(empty, VOCAB).count() == 0
    assert bpe_pairs.round_trip_digests(empty, VOCAB).count() == 0
    assert token_counts.token_counts(empty, VOCAB).count() == 0
    assert arrow_tokens.read_documents(arrow_tokens.write_tokens(empty, scratch_path(spark, "test-empty"), VOCAB, END)).count() == 0
