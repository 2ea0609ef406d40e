"""Alignment of two tokenizers over the same bytes, composed from fragments, with corpus-wide link counts.

Byte offsets where a token of A and a token of B both end cut a document into groups; every pair of an A and a B
occurrence of one group is a link, and the count of an id pair is the number of documents that hold it linked.

A *fragment* is what a byte range yields: an open prefix (tokens before its first cut), closed groups and an open suffix
(tokens after its last cut). Fragments form a monoid: composing two closes one more group out of the left suffix and
the right prefix, and is associative, so the fragments of a very long document, made by any number of Spark tasks, are
reduced as a tree of ``FAN`` children a node. A range is tokenized inside a window that reaches back to the last
and on to the next place that no token of either tokenizer spans (a blank after a visible character), so its tokens are
those of the whole document; ranges themselves end anywhere, also inside a token, which belongs to the range it ends in.
Documents up to ``RANGE_BYTES`` are one fragment. What lies between two such places is a segment, mostly a word; a worker
tokenizes a segment once and remembers about ``SEGMENTS`` of them.

Blocks of documents keep each distinct unit (a segment, or a group of a composed document) once, with how often each document holds it. A block sends one row per
distinct id pair into the corpus counts and gets one row back for each, so a pair that every document
holds costs one row a block; the best count per A id is a table of at most one row per vocabulary entry, which is broadcast.

Defined results: null and empty texts, and texts whose joined token bytes differ from blank + text (a text that holds
U+2581, say), have no tokens, zeros and an empty digest. Every row is a document of its own: repeated rows count
twice, ids may be null or repeated. An empty table gives no rows. Other columns are ignored. A run of more than
``RANGE_BYTES`` without a place to cut is one range; memory follows the longest such run and the tokens of one document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.bpe_pairs import vocabulary_path
from newslens.llm.pretokens import flat_gather, forget, worker_state
from newslens.runtime import materialize

OWNER = "token_alignment"
RANGE_BYTES = 65_536
BLOCK_BYTES = 4 << 20
STEP_BYTES = 1 << 19  # text that is split at once
SEGMENTS = 1 << 16  # segments a worker remembers between blocks; beyond it the table starts anew (same results, more work)
PAIR_SLICE = 1 << 21  # links expanded at once
FAN = 8
# Fixed value: how byte-level vocabularies of this family split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_VISIBLE = re.compile(r"[!-~\w]")
_CUT = re.compile(r"(?<=[!-~\w]) (?=.)", re.S)
_BLANK = re.compile(rb"[!-~\x80-\xff] ")
_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
DIGEST_COLUMNS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


class Tokenizers:
    """Both tokenizers with the bytes of every token.

    Where the merges of A are in the order of the ids they make, tiktoken gives the same ids several times faster; it gets the
    segments of Latin letters, whose character classes no Unicode version changes, and the library all others.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.path_a, self._library = path_a, None
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_a = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for name, number in vocab.items():
            self.bytes_a[number] = b"".join(letters.get(c, c.encode()) for c in name)
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        plain = {self.bytes_a[i]: i for name, i in vocab.items() if name not in added}
        self.fast = None
        if made == sorted(made) and len(plain) == 256 + len(set(made)):
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a blank inside leave no place to cut a long text")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path_a)
            self._library.no_truncation()
            self._library.no_padding()
            self._library.encode_special_tokens = True
        return self._library

    def is_easy(self, segment: str) -> bool:
        """Whether tiktoken may read a segment in one go with others: Latin, and its last character is visible."""
        return self.fast is not None and segment != "" and max(segment) < "\u0250" and bool(_VISIBLE.match(segment[-1]))

    def ids_a(self, easy: list[str], hard: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, first the easy ones, and how many each has."""
        flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if easy:
            text = " " + " ".join(easy)
            flat.append(np.array(self.fast.encode_ordinary(text), np.int64))
            lengths = np.array([len(s.encode()) + 1 for s in easy], np.int64)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.size_a[flat[-1]]), np.cumsum(lengths), "right"), prepend=0))
        if hard:
            ids = [e.ids for e in self.library.encode_batch_fast([f" {s}" for s in hard], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64))
            counts.append(np.array([len(x) for x in ids], np.int64))
        return np.concatenate(flat), np.concatenate(counts)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Segments:
    """Segments a worker has met, each tokenized once. A segment stands after a blank.

    ``said`` holds its groups as text; ``table()`` has per segment whether both tokenizers spell it, and its ids and
    groups in pools. Segments that are not spelled have none.
    """

    def __init__(self, tokens: Tokenizers):
        self.tokens = tokens
        sizes = [b"%d%c" % (i, c) for c in b",|;" for i in range(max(len(tokens.bytes_a), len(tokens.bytes_b)))]
        self._decimal_size = np.array([len(x) for x in sizes], np.int64)
        self._decimal_at = np.cumsum(self._decimal_size) - self._decimal_size
        self._decimals = np.frombuffer(b"".join(sizes), np.uint8)
        self.start_anew()

    def start_anew(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[bytes] = []
        self.held = 0
        none = np.zeros(0, np.int32)
        self._parts = [dict(good=none.astype(bool), n_a=none, n_b=none, groups=none, links=none.astype(np.int64), a=none, b=none, group_a=none, group_b=none)]

    def full(self) -> bool:
        return len(self.number) > SEGMENTS or self.held > SEGMENTS * 64

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The number of every segment of some texts."""
        known = self.number
        new = list(dict.fromkeys([s for words in texts for s in words if s not in known]))
        if new:
            self._learn(new)
        find = known.__getitem__
        return [np.array(list(map(find, words)), np.int64) for words in texts]

    def table(self) -> dict[str, np.ndarray]:
        if len(self._parts) > 1:
            self._parts = [{k: np.concatenate([p[k] for p in self._parts]) for k in self._parts[0]}]
        return self._parts[0]

    def _learn(self, new: list[str]) -> None:
        tokens = self.tokens
        easy = [s for s in new if tokens.is_easy(s)]
        hard = [s for s in new if not tokens.is_easy(s)] if len(easy) < len(new) else []
        new = easy + hard
        texts = [b" " + s.encode() for s in new]
        ids_b = tokens.b.encode(new, out_type=int, num_threads=1)
        encoded = tokens.ids_a(easy, hard), (np.fromiter(chain.from_iterable(ids_b), np.int64), np.array([len(x) for x in ids_b], np.int64))
        sides = []
        length = np.array([len(t) for t in texts], np.int64)
        good = np.ones(len(new), bool)
        for (flat, n), spell, sizes in zip(encoded, (tokens.bytes_a, tokens.bytes_b), (tokens.size_a, tokens.size_b)):
            owner = np.repeat(np.arange(len(new)), n)
            good &= np.bincount(owner, weights=sizes[flat], minlength=len(new)) == length
            sides.append([flat, n, owner, spell, sizes])
        for flat, _, owner, spell, _ in sides:
            spelled = np.frombuffer(b"".join(map(spell.__getitem__, flat[good[owner]].tolist())), np.uint8)
            wanted = np.frombuffer(b"".join([t for t, ok in zip(texts, good) if ok]), np.uint8)
            if not np.array_equal(spelled, wanted):
                at = np.repeat(np.flatnonzero(good), length[good])
                good[at[spelled != wanted]] = False
        for side in sides:
            keep = good[side[2]]
            side[0], side[1] = side[0][keep], np.where(good, side[1], 0)
        (a, n_a, _, _, size_a), (b, n_b, _, _, size_b) = sides
        end_a = np.cumsum(size_a[a])
        whole = Fragment.of(a, end_a, b, np.cumsum(size_b[b]))
        group_a, group_b = np.diff(whole.cut_a, prepend=0), np.diff(whole.cut_b, prepend=0)
        groups = np.diff(np.searchsorted(whole.cut_a, np.cumsum(n_a), "right"), prepend=0)
        links = np.bincount(np.repeat(np.arange(len(new)), groups), weights=group_a * group_b, minlength=len(new)).astype(np.int64)
        said, ends = self._spelled(whole, group_a, group_b, np.cumsum(groups))
        begin = 0
        for s, end in zip(new, ends.tolist()):
            self.number[s] = len(self.said)
            self.said.append(said[begin : max(begin, end - 1)])
            begin = end
        self.held += int(length.sum())
        learnt = dict(n_a=n_a, n_b=n_b, groups=groups, links=links, a=a, b=b, group_a=group_a, group_b=group_b)
        self._parts.append(dict(good=good) | {k: v if k == "links" else v.astype(np.int32) for k, v in learnt.items()})

    def _spelled(self, whole: Fragment, group_a: np.ndarray, group_b: np.ndarray, upto: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, each with a semicolon behind it, and where the text of the first ``upto`` groups ends."""
        size = len(self._decimal_size) // 3
        ids, comma = np.empty(len(whole.a) + len(whole.b), np.int64), np.zeros(len(whole.a) + len(whole.b), np.int64)
        ids[np.arange(len(whole.a)) + np.repeat(whole.cut_b - group_b, group_a)] = whole.a
        ids[np.arange(len(whole.b)) + np.repeat(whole.cut_a, group_b)] = whole.b
        comma[whole.cut_a + whole.cut_b - group_b - 1] = 1
        comma[whole.cut_a + whole.cut_b - 1] = 2
        index = comma * size + ids
        ends = np.concatenate([[0], np.cumsum(self._decimal_size[index])])
        tokens = np.concatenate([[0], whole.cut_a + whole.cut_b])
        return flat_gather(self._decimals, self._decimal_at, self._decimal_size, index).tobytes(), ends[tokens[upto]]


def segments_of(paths: tuple[str, str]) -> Segments:
    return worker_state(OWNER, paths, lambda: Segments(Tokenizers(*paths)))


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers below 2^32, compressed by byte planes, as the high ones are mostly zero."""
    raw = [np.asarray(x).astype(np.uint32) for x in arrays]
    body = b"".join([np.array([len(x) for x in raw], np.uint32).tobytes(), *[x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in raw]])
    return np.array([len(raw), len(body)], np.uint64).tobytes() + pa.compress(body, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    many, size = np.frombuffer(data[:16], np.uint64).tolist()
    raw = pa.decompress(data[16:], size, "zstd", asbytes=True)
    out, at = [], 4 * many
    for n in np.frombuffer(raw[:at], np.uint32).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64))
        at += 4 * n
    return out


class Fragment:
    """Tokens of a stretch of bytes, and how many of each side lie before each cut in it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray):
        self.a, self.b, self.cut_a, self.cut_b = a, b, cut_a, cut_b

    @classmethod
    def of(cls, a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray) -> Fragment:
        """From ids and the (increasing) offsets where they end."""
        if not len(end_a) or not len(end_b):
            return cls(a, b, np.zeros(0, np.int64), np.zeros(0, np.int64))
        low = min(end_a[0], end_b[0])
        marks = np.zeros(max(end_a[-1], end_b[-1]) - low + 1, np.uint8)
        marks[end_a - low] += 1
        marks[end_b - low] += 2
        cuts = np.flatnonzero(marks == 3) + low
        return cls(a, b, np.searchsorted(end_a, cuts, "right"), np.searchsorted(end_b, cuts, "right"))

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.a[: self.cut_a[0]], self.b[: self.cut_b[0]]) if len(self.cut_a) else (self.a, self.b)

    def suffix(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.a[self.cut_a[-1] :], self.b[self.cut_b[-1] :]) if len(self.cut_a) else (self.a, self.b)

    def closed(self) -> list[tuple[list[int], list[int]]]:
        """Groups between the first and the last cut."""
        bounds = zip(self.cut_a[:-1], self.cut_a[1:], self.cut_b[:-1], self.cut_b[1:])
        return [(self.a[p:q].tolist(), self.b[r:s].tolist()) for p, q, r, s in bounds]

    def then(self, other: Fragment) -> Fragment:
        """Composition: this suffix and the other's prefix become one closed group."""
        joined = [np.concatenate(pair) for pair in ((self.a, other.a), (self.b, other.b))]
        cuts = [np.concatenate(pair) for pair in ((self.cut_a, other.cut_a + len(self.a)), (self.cut_b, other.cut_b + len(self.b)))]
        return Fragment(*joined, *cuts)

    def packed(self) -> bytes:
        return pack([self.a, self.b, np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)])

    @classmethod
    def unpacked(cls, data: bytes) -> Fragment:
        a, b, cut_a, cut_b = unpack(data)
        return cls(a, b, np.cumsum(cut_a), np.cumsum(cut_b))


def next_cut(text: bytes, at: int) -> int:
    """First blank from ``at`` that follows a visible character and ends no text; the end if there is none."""
    at = max(at - 1, 0)
    while (found := _BLANK.search(text, at)) and found.end() < len(text):
        place = found.start() + 1
        if text[place - 1] < 0x80 or text[max(0, place - 4) : place].decode(errors="ignore")[-1:].isalnum():
            return place
        at = place
    return len(text)


def last_cut(text: bytes, low: int, high: int) -> int:
    """Last cut in ``(low, high]``, else ``low``."""
    back = 64
    while True:
        at, place = max(low + 1, high - back), low
        while (at := next_cut(text, at)) <= high and at < len(text):
            place, at = at, at + 1
        if place > low or high - back <= low:
            return place
        back *= 8


def windows(text: bytes, size: int = RANGE_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """``(window start, window end, range start, range end)`` in bytes of each range of a text."""
    begin, window = 0, 0
    while begin < len(text):
        end = min(begin + size, len(text))
        after = next_cut(text, end) if end < len(text) else end
        if after > end + size:
            end = after  # no place to cut for long: one range
        yield window, after, begin, end
        if end < len(text):
            window = last_cut(text, window, end)
        begin = end


def fragment_of(text: bytes, start: int, stop: int, segments: Segments) -> tuple[bool, Fragment]:
    """The fragment of the tokens that end in ``(start, stop]`` of a window, and whether the window is spelled by both."""
    if segments.full():
        segments.start_anew()
    (own,) = segments.numbers([_CUT.split(text[1:].decode())])
    known = segments.table()
    sides = []
    for c, sizes in (("a", segments.tokens.size_a), ("b", segments.tokens.size_b)):
        n = known[f"n_{c}"]
        ids = flat_gather(known[c], np.cumsum(n) - n, n, own)
        end = np.cumsum(sizes[ids])
        inside = slice(*np.searchsorted(end, [start, stop], "right"))
        sides += [ids[inside], end[inside]]
    return bool(known["good"][own].all()), Fragment.of(*sides)


def _window_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                full = b" " + text.encode()
                rows = [(uid, doc_id, k, full[w:x], s - w, e - w) for k, (w, x, s, e) in enumerate(windows(full))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if i != 1 else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], names=["uid", "doc_id", "part", "text", "start", "stop"])

    return docs.mapInArrow(run, "uid bigint, doc_id bigint, part bigint, text binary, start bigint, stop bigint")


_FRAGMENT = "uid bigint, doc_id bigint, part bigint, good boolean, data binary"
_NAMES = ["uid", "doc_id", "part", "good", "data"]


def fragments(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One row per byte range of every row of ``(uid, doc_id, text)``; ranges are dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = segments_of(paths)
        for batch in batches:
            for i in range(batch.num_rows):
                uid, doc_id, part, text, start, stop = (c[i].as_py() for c in batch.columns)
                good, made = fragment_of(text, start, stop, segments)
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, (uid, doc_id, part, good, made.packed())))], schema=_fragment_schema())

    return _window_rows(docs).repartition("uid", "part").mapInArrow(run, _FRAGMENT)


def _fragment_schema() -> pa.Schema:
    kinds = [pa.int64()] * 3 + [pa.bool_(), pa.binary()]
    return pa.schema(list(zip(_NAMES, kinds)))


def composed(parts: DataFrame, most: int) -> DataFrame:
    """One fragment per document, by a tree of ``FAN`` children a node; no part has a number above ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, part, children in zip(*[batch.column(i) for i in range(3)]):
                children = sorted(children.as_py(), key=lambda c: c["part"])
                whole = reduce(Fragment.then, [Fragment.unpacked(c["data"]) for c in children])
                row = (uid.as_py(), children[0]["doc_id"], part.as_py(), all(c["good"] for c in children), whole.packed())
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, row))], schema=_fragment_schema())

    while most:
        nodes = parts.groupBy("uid", F.floor(F.col("part") / FAN).alias("node")).agg(F.collect_list(F.struct(*_NAMES[1:])).alias("children"))
        parts, most = nodes.mapInArrow(run, _FRAGMENT), most // FAN
    return parts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each group, and place of each member within its group."""
    starts = np.cumsum(counts) - counts
    return starts, np.arange(counts.sum()) - np.repeat(starts, counts)


def distinct_groups(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place per distinct group, and of each group which one it is; hashes find them, tokens confirm them."""
    (at_a, in_a), (at_b, in_b) = _places(n_a), _places(n_b)
    key = np.add.reduceat(mixed((a + 1).astype(np.uint64) * _GOLD + in_a.astype(np.uint64)), at_a)
    key += np.add.reduceat(mixed((b + 1).astype(np.uint64) * _M1 + in_b.astype(np.uint64)), at_b)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    same = first[which]
    equal = np.array_equal(n_a, n_a[same]) and np.array_equal(n_b, n_b[same])
    equal = equal and np.array_equal(a, a[np.repeat(at_a[same], n_a) + in_a]) and np.array_equal(b, b[np.repeat(at_b[same], n_b) + in_b])
    if not equal:  # two groups with one hash
        seen: dict[tuple[bytes, bytes], int] = {}
        which = np.array([seen.setdefault((a[p : p + x].tobytes(), b[q : q + y].tobytes()), len(seen)) for p, x, q, y in zip(at_a, n_a, at_b, n_b)])
        _, first = np.unique(which, return_index=True)
    return first, which


def group_pairs(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(group, id pair)`` of every link of the groups, in slices of bounded size."""
    (at_a, _), (at_b, _) = _places(n_a), _places(n_b)
    total = np.cumsum(n_a * n_b)
    begin = 0
    while begin < len(n_a):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIR_SLICE, "right")))
        links = (n_a * n_b)[begin:end]
        group = np.repeat(np.arange(begin, end), links)
        _, place = _places(links)
        yield group, a[at_a[group] + place // n_b[group]] << 32 | b[at_b[group] + place % n_b[group]]
        begin = end


class Block:
    """Some documents: their distinct units once, and ``(document, unit, times)``. ``groups``: how many groups each unit has."""

    def __init__(self, sizes, which, times, groups, a, n_a, b, n_b):
        self.sizes, self.which, self.times, self.groups, self.a, self.n_a, self.b, self.n_b = (np.asarray(x, np.int64) for x in (sizes, which, times, groups, a, n_a, b, n_b))

    def packed(self) -> bytes:
        return pack([self.sizes, self.which, self.times, self.groups, self.a, self.n_a, self.b, self.n_b])

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        return cls(*unpack(data))

    def unit_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(unit, id pair)`` of every link of the units."""
        owner = np.repeat(np.arange(len(self.groups)), self.groups)
        for group, pair in group_pairs(self.a, self.n_a, self.b, self.n_b):
            yield owner[group], pair

    def documents_per_pair(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct id pairs, and how many documents of the block hold each."""
        slices = list(self.unit_pairs())
        if not slices:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unit, pair = (np.concatenate(x) for x in zip(*slices))
        pairs, index = np.unique(pair, return_inverse=True)
        n = np.bincount(unit, minlength=len(self.groups))
        at, rows = np.cumsum(n) - n, np.concatenate([[0], np.cumsum(self.sizes)])
        held = np.zeros(len(pairs), np.int64)
        step = max(1, PAIR_SLICE // len(pairs))
        for first in range(0, len(self.sizes), step):  # some documents at a time, one bit per document and pair
            last = min(first + step, len(self.sizes))
            which = self.which[rows[first] : rows[last]]
            doc = np.repeat(np.repeat(np.arange(last - first), self.sizes[first:last]), n[which])
            _, place = _places(n[which])
            holds = np.zeros((last - first, len(pairs)), bool)
            holds[doc, index[np.repeat(at[which], n[which]) + place]] = True
            held += holds.sum(axis=0)
        return pairs, held

    def sums(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document: links that are the best of their A id, and the sum of the counts of all links."""
        per_unit = np.zeros((2, len(self.groups)))
        order = np.argsort(pairs, kind="stable")
        pairs, values = pairs[order], (best[order].astype(np.int64), counts[order])
        for unit, pair in self.unit_pairs():
            at = np.searchsorted(pairs, pair)
            for into, value in zip(per_unit, values):
                into += np.bincount(unit, weights=value[at], minlength=len(into))  # exact below 2^53
        per_unit = per_unit.astype(np.int64)
        totals = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(per_unit[:, self.which] * self.times, axis=1)], axis=1)
        ends = np.cumsum(self.sizes)
        both = totals[:, ends] - totals[:, ends - self.sizes]
        return both[0], both[1]


NOTHING = dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="")


def composed_block(doc_id: int | None, whole: Fragment | None) -> tuple[list[dict], bytes]:
    """Result of one composed document, and its block; ``None`` if it has no tokens."""
    if whole is None or not len(whole.cut_a):
        return [dict(doc_id=doc_id, **NOTHING)], Block([0], *[[]] * 7).packed()
    n_a, n_b = np.diff(whole.cut_a, prepend=0), np.diff(whole.cut_b, prepend=0)
    first, which = distinct_groups(whole.a, n_a, whole.b, n_b)
    (at_a, _), (at_b, _) = _places(n_a), _places(n_b)
    own_a, own_b = [whole.a[p : p + n] for p, n in zip(at_a[first], n_a[first])], [whole.b[p : p + n] for p, n in zip(at_b[first], n_b[first])]
    spelled = [f"{','.join(map(str, x.tolist()))}|{','.join(map(str, y.tolist()))}" for x, y in zip(own_a, own_b)]
    digest = hashlib.sha256(";".join([spelled[g] for g in which.tolist()]).encode()).hexdigest()
    row = dict(doc_id=doc_id, n_a=len(whole.a), n_b=len(whole.b), n_groups=len(which), n_links=int((n_a * n_b).sum()), groups_sha256=digest)
    times = np.bincount(which)
    k = len(first)
    return [row], Block([k], np.arange(k), times, np.ones(k), np.concatenate(own_a), n_a[first], np.concatenate(own_b), n_b[first]).packed()


class BlockBuilder:
    """Collects whole texts, each the sequence of its segments."""

    def __init__(self, segments: Segments):
        if segments.full():
            segments.start_anew()
        self.segments, self.ids, self.texts, self.size = segments, [], [], 0

    def add(self, ids: list, texts: list[str], size: int) -> None:
        self.texts += self.segments.numbers([_CUT.split(t) if t else [] for t in texts])
        self.ids += ids
        self.size += size

    def block(self) -> tuple[list[dict], bytes]:
        known, said = self.segments.table(), self.segments.said
        measures = np.stack([known[c] for c in ("n_a", "n_b", "groups", "links")], 1)
        rows, used = [], []
        for doc_id, own in zip(self.ids, self.texts):
            if not len(own) or not known["good"][own].all():
                rows.append(dict(doc_id=doc_id, **NOTHING))
                used.append(own[:0])
                continue
            n_a, n_b, groups, links = measures[own].sum(axis=0).tolist()
            digest = hashlib.sha256(b";".join([said[u] for u in own.tolist()])).hexdigest()
            rows.append(dict(doc_id=doc_id, n_a=n_a, n_b=n_b, n_groups=groups, n_links=links, groups_sha256=digest))
            used.append(own)
        units, which = np.unique(np.concatenate([np.zeros(0, np.int64), *used]), return_inverse=True)
        doc = np.repeat(np.arange(len(used)), [len(x) for x in used])
        entry, times = np.unique(doc * max(1, len(units)) + which, return_counts=True)
        sizes = np.bincount(entry // max(1, len(units)), minlength=len(used))

        def taken(pool: str, count: str) -> np.ndarray:
            return flat_gather(known[pool], np.cumsum(known[count]) - known[count], known[count], units)

        parts = (taken("a", "n_a"), taken("group_a", "groups"), taken("b", "n_b"), taken("group_b", "groups"))
        return rows, Block(sizes, entry % max(1, len(units)), times, known["groups"][units], *parts).packed()


_ROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())])


def _block_batch(number: int, made: tuple[list[dict], bytes]) -> pa.RecordBatch:
    columns = [pa.array([number]), pa.array([made[0]], pa.list_(pa.struct(list(_ROW)))), pa.array([made[1]], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "data"])


_BLOCK = f"block bigint, docs array<struct<{', '.join(c.replace(' ', ': ') for c in DIGEST_COLUMNS.split(', '))}>>, data binary"


def blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``(block, docs, data)`` of all rows of ``(doc_id, text)``, stored."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, number = segments_of(paths), TaskContext.get().partitionId() << 32
        builder = BlockBuilder(segments)
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                end, size = begin, 0
                while end < batch.num_rows and size < STEP_BYTES:
                    size += len(batch.column(1)[end].as_buffer() or b"")
                    end += 1
                builder.add(batch.column(0)[begin:end].to_pylist(), batch.column(1)[begin:end].to_pylist(), size)
                begin = end
                if builder.size >= BLOCK_BYTES:
                    yield _block_batch(number, builder.block())
                    builder, number = BlockBuilder(segments), number + 1
        if builder.ids:
            yield _block_batch(number, builder.block())

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(batch.num_rows):
                _, doc_id, _, good, data = (c[i].as_py() for c in batch.columns)
                yield _block_batch(number, composed_block(doc_id, Fragment.unpacked(data) if good else None))
                number += 1

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    is_long = F.octet_length("text") >= RANGE_BYTES
    longest = rows.agg(F.max(F.octet_length("text"))).first()[0] or 0
    whole = composed(fragments(rows.filter(is_long).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), paths), longest // RANGE_BYTES + 1)
    return materialize(rows.filter(~is_long).mapInArrow(short, _BLOCK).unionByName(whole.mapInArrow(long, _BLOCK)), "alignment-blocks")


def pair_counts(stored: DataFrame) -> DataFrame:
    """``(block, pair, count, best)``: of every id pair of a block its corpus-wide count, and whether its A id has no higher one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(f"{OWNER}-pairs")
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs, held = Block.unpacked(data.as_buffer().to_pybytes()).documents_per_pair()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(held)], names=["block", "pair", "held"])

    held = materialize(stored.select("block", "data").mapInArrow(run, "block bigint, pair bigint, held bigint"), "alignment-pairs")
    counts = materialize(held.groupBy("pair").agg(F.sum("held").alias("count")), "alignment-counts")
    a = F.shiftright("pair", 32).alias("a")
    highest = counts.groupBy(a).agg(F.max("count").alias("highest"))  # at most one row per entry of A's vocabulary
    marked = counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return held.select("block", "pair").join(marked, "pair")


def aligned(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = pa.Table.from_pylist(left.column("docs")[0].as_py(), schema=_ROW)
        block = Block.unpacked(left.column("data")[0].as_buffer().to_pybytes())
        best, total = block.sums(*[right.column(c).to_numpy() for c in ("pair", "count", "best")])
        return docs.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))

    stored = blocks(docs, paths)
    joined = stored.groupBy("block").cogroup(pair_counts(stored).groupBy("block"))
    out = joined.applyInArrow(run, f"{DIGEST_COLUMNS}, n_best bigint, count_sum bigint")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return aligned(docs, (vocabulary_path(), vocabulary_path("piece_bpe_32k.model")))
