"""Personal data: base patterns, and a character BiLSTM-CRF trained on the spans they label.

The base spans of a text are exact: leftmost, non-overlapping per kind, failing matches dropped. The
network sees only character classes (lower, upper, digit, each common sign), so it learns shapes
and finds those the patterns miss. It is trained on windows of at most about ``SAMPLE`` documents, chosen
by a hash of their ids. Every text is cut into windows of ``WIDTH`` characters, ``STRIDE`` apart;
a character's tag is that of the window in which it lies farther from the edge, so the cores of
the windows tile the text and spans are joined across them. A found span counts if it holds a digit or
``@`` and touches no match of a base pattern, kept or dropped; windows without such a
character cannot give one and are not decoded, which changes no result.

Defined results: a null or empty text has no spans; without labelled spans in the sample there is
no network and base spans are all. Rows are independent, repeated rows give repeated results; a null id never
is part of the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.bilstm_crf import BiLstmCrf
from newslens.llm.pretokens import forget

OWNER = "pii"
KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 128, 96
EDGE = (WIDTH - STRIDE) // 2
SAMPLE = 12_000
WINDOWS = 6_000
STEPS = 160
LEAST_LENGTH = 7
DECODE_BATCH = 512
# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SIGNS = "@.-+()_%/:,;\"'#=|<>*&$!?"
PAD, LOWER, UPPER, DIGIT, BEYOND, BLANK, LINE, OTHER = range(8)
CLASSES = 8 + len(SIGNS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part is the whole run before an ``@``, so each ``@`` is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """``(kind, start, end)`` of what holds, by kind and start, and ``(start, end)`` of what a pattern matched but a check refused."""
    kept = [(0, a, b) for a, b in emails(text)]
    refused = []
    for m in IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
        kept.append((1, *m.span())) if good else refused.append(m.span())
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        kept.append((2, *m.span())) if 16 <= len(digits) <= 19 and luhn(digits) else refused.append(m.span())
    for m in PHONE.finditer(text):
        kept.append((3, *m.span())) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15 else refused.append(m.span())
    return kept, refused


def _class_table() -> np.ndarray:
    table = np.full(129, OTHER, np.uint8)
    table[128] = BEYOND
    table[97:123], table[65:91], table[48:58] = LOWER, UPPER, DIGIT
    table[32], table[10] = BLANK, LINE
    for i, c in enumerate(SIGNS):
        table[ord(c)] = 8 + i
    return table


CLASS_OF = _class_table()


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASS_OF[np.minimum(points, 128)]


def wanted_windows(codes: np.ndarray) -> np.ndarray:
    """Numbers of the windows that hold a digit or ``@``; window k begins at ``k * STRIDE``."""
    at = np.flatnonzero((codes == DIGIT) | (codes == 8))
    last = max(0, -(-(len(codes) - WIDTH) // STRIDE))
    high = np.minimum(at // STRIDE, last)
    low = np.maximum(-(-(at - WIDTH + 1) // STRIDE), 0)
    return np.unique(np.concatenate([high, np.minimum(low, last)])) if len(at) else at


def cut(codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    padded = np.concatenate([codes, np.full(WIDTH, PAD, np.uint8)])
    return padded[numbers[:, None] * STRIDE + np.arange(WIDTH)]


def labelled_windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of one text with the tags of its base spans: 0 outside, then begin and inside of each kind."""
    codes = coded(text)
    tags = np.zeros(len(codes), np.uint8)
    for kind, start, end in reversed(base_spans(text)[0]):
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    numbers = wanted_windows(codes)
    return cut(codes, numbers), cut(tags, numbers)


def reconciled(numbers: np.ndarray, tags: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Spans of one text from the tags of its windows."""
    last = max(0, -(-(length - WIDTH) // STRIDE))
    core = np.ones(tags.shape, bool)
    core[numbers > 0, :EDGE] = False
    core[numbers < last, WIDTH - EDGE :] = False
    place = numbers[:, None] * STRIDE + np.arange(WIDTH)
    keep = core & (tags > 0) & (place < length)
    at, tag = place[keep], tags[keep]
    if not len(at):
        return []
    kind = (tag - 1) // 2
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at)) - 1
    return list(zip(kind[starts].tolist(), at[starts].tolist(), (at[ends] + 1).tolist()))


def train(docs: DataFrame, id_col: str, text: str, sample: int = SAMPLE, steps: int = STEPS) -> BiLstmCrf | None:
    """Fit on the windows of a bounded sample of documents; only these windows reach the driver."""
    rows = docs.filter(F.col(id_col).isNotNull()).count()
    share = min(1.0, sample / max(rows, 1))
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        for batch in batches:
            windows, tags = [], []
            for value in batch.column(0):
                w, t = labelled_windows(value.as_py() or "")
                windows.extend(x.tobytes() for x in w)
                tags.extend(x.tobytes() for x in t)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(tags, pa.binary())], names=["codes", "tags"])

    drawn = docs.filter(F.col(id_col).isNotNull() & (draw < share)).select(F.col(text).cast("string").alias("text"))
    made = drawn.mapInArrow(run, "codes binary, tags binary").distinct()
    marked = made.withColumn("any", F.rtrim(F.hex("tags"), F.lit("0")) != "").orderBy(F.desc("any"), F.xxhash64("codes")).limit(WINDOWS)
    got = marked.toPandas().sort_values(["any", "codes", "tags"])
    if not got["any"].any():
        return None
    windows = np.frombuffer(b"".join(got.codes), np.uint8).reshape(-1, WIDTH)
    tags = np.frombuffer(b"".join(got.tags), np.uint8).reshape(-1, WIDTH)
    model = BiLstmCrf(CLASSES, 1 + 2 * len(KINDS))
    model.fit(windows, tags, steps)
    return model


def all_spans(texts: list[str], model: BiLstmCrf | None) -> Iterator[tuple[list, list]]:
    """Base spans and added spans of each text; windows of several texts are decoded together."""
    held: list[tuple[list, list, np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> Iterator[tuple[list, list]]:
        windows = [cut(codes, numbers) for _, _, codes, numbers in held]
        every = np.concatenate(windows)
        tags = [np.zeros((0, WIDTH), np.uint8)]
        tags += [model.decode(every[i : i + DECODE_BATCH]) for i in range(0, len(every), DECODE_BATCH)]
        decoded, at = np.concatenate(tags), 0
        for (base, refused, codes, numbers), w in zip(held, windows):
            part = decoded[at : at + len(w)]
            at += len(w)
            taken = sorted([(a, b) for _, a, b in base] + refused)
            starts = np.array([a for a, _ in taken], np.int64)
            reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
            added = []
            for kind, a, b in reconciled(numbers, part, len(codes)):
                k = int(np.searchsorted(starts, b))  # pattern matches that begin before the span ends
                inside = codes[a:b]
                if b - a >= LEAST_LENGTH and not (k and reach[k - 1] > a) and ((inside == DIGIT) | (inside == 8)).any():
                    added.append((kind, a, b))
            yield base, added

    for value in texts:
        base, refused = base_spans(value)
        codes = coded(value)
        numbers = wanted_windows(codes) if model is not None else np.zeros(0, np.int64)
        held.append((base, refused, codes, numbers))
        waiting += len(numbers) + 1
        if waiting >= 4 * DECODE_BATCH:
            yield from flush() if model is not None else ((b, []) for b, _, _, _ in held)
            held, waiting = [], 0
    if held:
        yield from flush() if model is not None else ((b, []) for b, _, _, _ in held)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, model: BiLstmCrf | None, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add ``out``: ``array<struct<kind, start, end, base>>`` by kind and start, over whole texts."""
    names = [c for c in docs.columns if c.lower() != out.lower()]
    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("base", "boolean")
    schema = docs.select(*names).schema.add(out, T.ArrayType(span))
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        for batch in batches:
            texts = batch.column(names.index(text))
            rows = []
            for base, added in all_spans([x.as_py() or "" for x in texts], model):
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in every])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(kind_of))], names=[*names, out])

    return docs.select(*names).mapInArrow(run, schema)


def report(docs: DataFrame, model: BiLstmCrf | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        for batch in batches:
            counts, digests, spans, more = [[] for _ in KINDS], [], [], []
            for base, added in all_spans([x.as_py() or "" for x in batch.column(1)], model):
                for k in range(len(KINDS)):
                    counts[k].append(sum(1 for s in base if s[0] == k))
                digests.append(sha256(written(base).encode()).hexdigest())
                spans.append(written(base + added))
                more.append(len(added))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = ", ".join(f"n_{k} bigint" for k in KINDS)
    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {counted}, base_sha256 string, spans string, n_added bigint")


def mask(docs: DataFrame, model: BiLstmCrf | None, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one of the first kind."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(OWNER)
        for batch in batches:
            at = names.index(text)
            values = [x.as_py() for x in batch.column(at)]
            cleaned = []
            for value, (base, added) in zip(values, all_spans([v or "" for v in values], model)):
                if base or added:
                    parts, end = [], 0
                    for a, b, k in sorted((a, b, k) for k, a, b in base + added):
                        if a >= end:
                            parts += [value[end:a], f"<{KINDS[k]}>"]
                        end = max(end, b)
                    value = "".join([*parts, value[end:]])
                cleaned.append(value)
            columns = [*batch.columns]
            columns[at] = pa.array(cleaned, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op9_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return report(docs, train(docs, "doc_id", "text"))
