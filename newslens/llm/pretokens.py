"""Byte-level pre-tokens of whole texts, in numpy, and a bounded table of what is known of each.

The byte-level pre-tokeniser cuts a text by the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Whether a token starts at a character depends on a few neighbouring characters only, so
``token_starts`` finds all of them with array operations over the UTF-8 bytes of many texts.
A pre-token is looked up by a 64-bit tabulation hash; only pre-tokens that a worker has not
seen reach the merge loops.

Defined results: a null text is an empty text; an empty text has no tokens; special tokens
found in a text become one token of their own, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

# Bytes worked on at once: arrays of 8 bytes per byte stay near the CPU caches.
CHUNK_BYTES = 1 << 20
# Pre-tokens a worker remembers; beyond it the table starts anew (same results, more work).
TABLE_ENTRIES = 1 << 19
HASHED_POSITIONS = 64
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
# The characters that the pattern's \s matches, without the blank.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


def worker_state(owner: str, key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker and key; a worker that is started anew builds it again.

    A worker serves many jobs, so it holds the objects of one owner only: those of the last one go.
    """
    held = sys.modules.setdefault("_newslens_worker_state", types.ModuleType("_newslens_worker_state"))
    if getattr(held, "owner", None) != owner:
        held.owner, held.objects = owner, {}
        pa.default_memory_pool().release_unused()
    if key not in held.objects:
        held.objects[key] = make()
    return held.objects[key]


def forget(owner: str) -> None:
    """For tasks that keep nothing: let go of what earlier jobs left in this worker."""
    worker_state(owner, (), object)


def character_classes(tokenizer) -> np.ndarray:
    """Class of every code point.

    Python's Unicode table decides for the code points it knows. For those it does not know, but
    the newer table of ``regex`` does, the tokenizer itself is asked.
    """
    import regex

    table = np.zeros(0x110000, np.uint8)
    known = np.ones(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = NUMBER
        elif kind == "Cn":
            known[c] = False
    table[list(WHITE_SPACE)] = SPACE
    table[0x20] = BLANK
    unknown = "".join(map(chr, np.flatnonzero(~known)))
    newer = "".join(regex.findall(r"[\p{L}\p{N}]+", unknown))
    if newer:
        cuts = tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"a{c}1\n" for c in newer))
        ends = {end for _, (_, end) in cuts}
        for i, c in enumerate(newer):
            at = 4 * i + 1  # the character's place: between a letter and a digit
            if at not in ends:
                table[ord(c)] = LETTER
            elif at + 1 not in ends:
                table[ord(c)] = NUMBER
    return table


def token_starts(data: np.ndarray, borders: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Byte offsets where pre-tokens start. ``borders`` are the offsets where texts start (ascending)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    cls = table[first]
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        at, b = lead[wide], first[wide].astype(np.int64)
        cont = lambda k: (data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.int64)
        two, three = b < 0xE0, b < 0xF0
        cp = np.where(two, (b & 0x1F) << 6 | cont(1), 0)
        m = ~two & three
        cp = np.where(m, (b & 0x0F) << 12 | cont(1) << 6 | cont(2), cp)
        m = ~three
        cp = np.where(m, (b & 0x07) << 18 | cont(1) << 12 | cont(2) << 6 | cont(3), cp)
        cls[wide] = table[np.minimum(cp, 0x10FFFF)]
    n = len(lead)
    kind = np.where(cls == SPACE, BLANK, cls)  # runs of white space are one class
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    text_start = np.zeros(n + 1, bool)
    text_start[np.searchsorted(lead, borders)] = True
    text_start[n] = True
    begins |= text_start[:n]
    run_end = np.empty(n, bool)  # the next character starts another run
    run_end[:-1] = begins[1:]
    run_end[-1] = True
    white = kind == BLANK
    # the last blank of a run that something follows stands alone or leads the next run
    starts = begins.copy()
    starts |= white & run_end & ~text_start[1:]
    led = np.zeros(n, bool)
    led[1:] = (cls[:-1] == BLANK) & begins[1:] & ~white[1:] & ~text_start[1:n]
    starts &= ~led
    # contractions: a lone apostrophe that no blank leads, then the letters of the pattern
    quote = np.flatnonzero((first == 0x27) & begins & ~led & run_end)
    quote = quote[quote + 1 < n]
    quote = quote[~text_start[quote + 1]]
    if len(quote):
        pad = np.concatenate([first, np.zeros(3, np.uint8)])
        a, b = pad[quote + 1], pad[quote + 2]
        crosses = text_start[np.minimum(quote + 2, n)]
        is_in = lambda x, of: np.isin(x, np.frombuffer(of, np.uint8))
        double = ~crosses & (((b == ord("e")) & is_in(a, b"rv")) | ((a == ord("l")) & (b == ord("l"))))
        taken = np.where(is_in(a, b"stmd"), 1, np.where(double, 2, 0))
        quote, taken = quote[taken > 0], taken[taken > 0]
        starts[quote + 1] = False
        after = quote + 1 + taken
        starts[after[after < n]] = True
    return lead[starts]


class Chunk:
    """Bytes of some whole texts, or of a slice of one long text, with the place of each text."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, rows: np.ndarray):
        self.data, self.borders, self.rows = data, borders, rows


def _safe_cut(data: np.ndarray, at: int) -> int:
    """First place from ``at`` where a blank between two ASCII letters starts a token."""
    step = 1 << 16
    while at + 2 < len(data):
        part = data[at - 1 : at + step + 1]
        low = part | 0x20
        letter = (low >= 97) & (low <= 122)
        found = np.flatnonzero((part[1:-1] == 0x20) & letter[:-2] & letter[2:])
        if len(found):
            return at + int(found[0])
        at += step - 1
    return len(data)


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Texts of an Arrow column in pieces of bounded size; a long text is cut between two words."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(off, off[row] + chunk_bytes, "right")) - 1)
        if last == row + 1 and off[last] - off[row] > chunk_bytes:
            at, end = int(off[row]), int(off[last])
            while at < end:
                text = every[at:end]
                cut = _safe_cut(text, chunk_bytes) if len(text) > chunk_bytes else len(text)
                yield Chunk(text[:cut], np.zeros(1, np.int64), np.array([row]))
                at += cut
        else:
            filled = np.flatnonzero(np.diff(off[row : last + 1])) + row
            if len(filled):
                yield Chunk(every[off[row] : off[last]], off[filled] - off[row], filled)
        row = last


def specials_in(data: np.ndarray, borders: np.ndarray, specials: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """``(start, end, id)`` of special tokens inside texts, leftmost first, never across two texts."""
    found = []
    blob = data.tobytes()
    for name, number in specials.items():
        at = blob.find(name)
        while at >= 0:
            k = int(np.searchsorted(borders, at, "right"))
            if k == len(borders) or borders[k] >= at + len(name):
                found.append((at, at + len(name), number))
                at = blob.find(name, at + len(name))
            else:
                at = blob.find(name, at + 1)
    found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, int]] = []
    for x in found:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def mixing_table(seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, HASHED_POSITIONS * 256, np.uint64, endpoint=False)


def segment_hashes(mix: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit tabulation hashes of segments that cover ``data`` without gaps."""
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    long = lengths > HASHED_POSITIONS
    if long.any():
        place = np.minimum(place, HASHED_POSITIONS - 1)
    h = np.add.reduceat(mix[(place << 8) + data], starts)
    for i in np.flatnonzero(long):
        piece = data[starts[i] : starts[i] + lengths[i]].tobytes()
        h[i] = int.from_bytes(blake2b(piece, digest_size=8).digest(), "little")
    return h


class Vocabulary:
    """What the vocabulary file says: merge ranks over byte symbols, token bytes, special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        # the printable stand-ins of bytes: printable ones stand for themselves, the rest follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        of_byte = {b: c for c, b in self.stand_in.items()}
        self.byte_ids = [ids[of_byte[b]] for b in range(256)]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token_bytes: list[bytes] = [b""] * self.size
        for name, number in ids.items():
            self.token_bytes[number] = bytes(self.stand_in[c] for c in name) if all(c in self.stand_in for c in name) else name.encode()
        self.specials = {}
        for t in spec["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()
            self.specials[t["content"].encode()] = t["id"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = rank, ids[a + b]
        self.classes = character_classes(self.tokenizer)


def vocabulary_of(owner: str, path: str) -> Vocabulary:
    return worker_state(owner, ("vocabulary", path), lambda: Vocabulary(path))


class PieceTable:
    """Hash table of pre-tokens in arrays: 64-bit key to entry, entry to its ids (or only their count).

    ``solve`` gets the bytes of new pre-tokens and returns ``(counts, ids)``; ids may be None.
    """

    def __init__(self, vocabulary: Vocabulary, solve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray | None]]):
        self.vocabulary, self.solve = vocabulary, solve
        self.mix = mixing_table()
        self.clear()

    def clear(self) -> None:
        self.bits, self.used, self.filled = 16, 0, 0
        self.keys, self.values = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.counts, self.offsets = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], slot[go]
        return out

    def _place(self, h: np.ndarray, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = free & (self.keys[slot] == h)
            self.values[slot[mine]] = entries[mine]
            h, entries, slot = h[~mine], entries[~mine], (slot[~mine] + 1) & mask

    def _add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray | None) -> None:
        entries = np.arange(self.used, self.used + len(h))
        room = len(self.counts)
        while room < self.used + len(h):
            room *= 2
        if room > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(room - len(self.counts), np.int32)])
            self.offsets = np.concatenate([self.offsets, np.zeros(room - len(self.offsets), np.int64)])
        self.counts[entries] = counts
        if ids is not None:
            self.offsets[entries] = self.filled + np.cumsum(counts) - counts
            while self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
        self.used += len(h)
        if 2 * self.used > 1 << self.bits:
            old, values = self.keys[self.keys != 0], self.values[self.keys != 0]
            while 2 * self.used > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(old, values)
        self._place(h, entries)

    def tokens(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every pre-token of the chunk, and the number of pre-tokens before each of its texts."""
        if self.used > TABLE_ENTRIES:
            self.clear()
        data, borders = chunk.data, chunk.borders
        special = specials_in(data, borders, self.vocabulary.specials)
        cuts = np.array([x for s, e, _ in special for x in (s, e) if x < len(data)], np.int64)
        starts = token_starts(data, np.unique(np.concatenate([borders, cuts])) if special else borders, self.vocabulary.classes)
        if special:  # a special token is one piece, whatever the pattern makes of it
            inside = np.zeros(len(data), bool)
            for s, e, _ in special:
                inside[s + 1 : e] = True
            starts = starts[~inside[starts]]
        lengths = np.diff(np.append(starts, len(data)))
        h = segment_hashes(self.mix, data, starts, lengths)
        h[h == 0] = 1  # 0 marks a free slot
        entries = self._find(h)
        new = np.flatnonzero(entries < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            at = new[first]
            blob = data.tobytes()
            counts, ids = self.solve([blob[s : s + n] for s, n in zip(starts[at].tolist(), lengths[at].tolist())])
            self._add(keys, counts, ids)
            entries[new] = self._find(h[new])
        return entries, np.searchsorted(starts, borders)

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries, one after the other, and how many each has."""
        counts = self.counts[entries].astype(np.int64)
        before = np.cumsum(counts) - counts
        return self.pool[np.repeat(self.offsets[entries] - before, counts) + np.arange(int(counts.sum()))], counts


def flat_gather(pool: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Concatenation of ``pool[offsets[i] : offsets[i] + lengths[i]]`` for i in ``index``."""
    n = lengths[index]
    before = np.cumsum(n) - n
    return pool[np.repeat(offsets[index] - before, n) + np.arange(int(n.sum()))]
