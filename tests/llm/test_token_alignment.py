"""Token alignment against the libraries and plain loops."""

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newslens.llm import token_alignment as ta
from newslens.llm.bpe_pairs import vocabulary_path

PATHS = (vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
WORDS = "the quick Brown it's été 中文字 Привет мир a<|endoftext|>b <s> x=1234567 \t \n\n   é́ ﬁ 😀 ... don't ==== 12.50".split(" ")


LIBRARIES = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


@pytest.fixture(scope="module")
def tokens():
    return ta.Segments(ta.Tokenizers(*PATHS))


def plain_groups(text):
    """Groups of one text by its definition, with byte offsets found token by token."""
    a_lib, b_lib = LIBRARIES
    a_lib.encode_special_tokens = True
    if not text:
        return []
    full = " " + text
    stand_in = {c: b for b, c in enumerate(ta._byte_letters())}
    sides = []
    for ids, spell in (
        (a_lib.encode(full, add_special_tokens=False).ids, lambda i: bytes(stand_in[c] for c in a_lib.id_to_token(i))),
        (b_lib.encode(text), lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, ends = 0, []
        for i in ids:
            at += len(spell(i))
            ends.append((at, i))
        if b"".join(map(spell, ids)) != full.encode():
            return []
        sides.append(ends)
    cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
    out, sides = [], [iter(side) for side in sides]
    for c in cuts:
        group = ([], [])
        for side, ids in zip(sides, group):
            for e, i in side:
                ids.append(i)
                if e == c:
                    break
        out.append(tuple(map(tuple, group)))
    return out


def plain_alignment(rows):
    groups = [plain_groups(t) for _, t in rows]
    held = Counter(p for g in groups for p in {(a, b) for x, y in g for a in x for b in y})
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for (i, _), g in zip(rows, groups):
        links = [(a, b) for x, y in g for a in x for b in y]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(out, key=repr)


def spark_alignment(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, BLOCK string")
    return sorted((tuple(r) for r in ta.aligned(docs, PATHS).collect()), key=repr)


def sample(rng, k):
    return " ".join(rng.choice(WORDS, k))


def test_equals_the_definition(spark):
    rng = np.random.default_rng(5)
    rows = [(i, sample(rng, int(rng.integers(1, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "▁ is not a blank"), (103, " "), (104, "   two  blanks "), (None, "no id"), (3, rows[3][1]), (3, rows[3][1]), (105, "\n"), (107, "ends in a blank "), (108, "two  "), (109, " \u3000 \xa0 x\u3000 y"), (106, "中" * 50)]
    assert spark_alignment(spark, rows) == plain_alignment(rows)


def test_long_texts_are_composed_from_ranges(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, sample(rng, 2500)) for i in range(3)]
    rows += [(10, "abcdef0123456789" * 9000), (11, sample(rng, 9000)), (12, "中文" * 30_000), (13, sample(rng, 3000) + " ▁ " + sample(rng, 3000)), (14, "short"), (15, sample(rng, 4000) + " ")]
    monkeypatch.setattr(ta, "RANGE_BYTES", 1 << 14)
    assert spark_alignment(spark, rows) == plain_alignment(rows)


def test_empty_table(spark):
    assert spark_alignment(spark, []) == []


def test_fragments_form_a_monoid(tokens):
    rng = np.random.default_rng(7)
    text = (" " + sample(rng, 400)).encode()
    good, made = ta.fragment_of(text, 0, len(text), tokens)
    assert good
    sides = [made.a, made.b]
    ends = [np.cumsum(s[x]) for s, x in zip((tokens.tokens.size_a, tokens.tokens.size_b), sides)]
    whole = ta.Fragment.of(sides[0], ends[0], sides[1], ends[1])

    def part(low, high):
        inside = [slice(*np.searchsorted(e, [low, high], "right")) for e in ends]
        return ta.Fragment.of(sides[0][inside[0]], ends[0][inside[0]], sides[1][inside[1]], ends[1][inside[1]])

    def same(x, y):
        return all(np.array_equal(getattr(x, c), getattr(y, c)) for c in ("a", "b", "cut_a", "cut_b"))

    for _ in range(30):
        places = [0, *sorted(rng.choice(len(text), 7, replace=False).tolist()), len(text)]
        parts = [part(x, y) for x, y in zip(places, places[1:])]
        from_left = reduce(ta.Fragment.then, parts)
        from_right = reduce(lambda right, left: left.then(right), reversed(parts))
        assert same(from_left, whole) and same(from_right, whole)
        x, y = parts[:2]
        middle = [x.then(y).closed()[len(x.closed()) : len(x.closed()) + 1]] if len(x.cut_a) and len(y.cut_a) else []
        for group in middle:  # the left suffix and the right prefix close one group
            assert group == [tuple([*s.tolist(), *p.tolist()] for s, p in zip(x.suffix(), y.prefix()))]


def test_every_byte_is_in_one_range_and_windows_start_at_cuts():
    rng = np.random.default_rng(8)
    for text in [sample(rng, 3000), "x" * 50_000, "ab " * 9000 + "y" * 40_000 + " cd" * 9000, "中 文" * 9000, "　   " * 4000]:
        full = b" " + text.encode()
        rows = list(ta.windows(full, 4096))
        assert rows[0][2] == 0 and rows[-1][3] == len(full)
        assert all(x[3] == y[2] for x, y in zip(rows, rows[1:]))
        for w, x, s, e in rows:
            assert w <= s < e <= x
            assert w == 0 or (full[w] == 0x20 and not full[:w].decode()[-1].isspace())
            assert x == len(full) or (full[x] == 0x20 and x + 1 < len(full))


def test_equal_hashes_do_not_join_groups(monkeypatch):
    monkeypatch.setattr(ta, "mixed", lambda x: x * np.uint64(0))
    a, n_a, b, n_b = (np.array(x) for x in ([1, 2, 1, 3], [1, 1, 2], [5, 5, 5], [1, 1, 1]))
    first, which = ta.distinct_groups(a, n_a, b, n_b)
    assert which.tolist() == [0, 1, 2] and first.tolist() == [0, 1, 2]


def test_both_ways_to_encode_a_segment_agree(tokens):
    rng = np.random.default_rng(9)
    letters = list("abcXYZéßñÿÆ'.,-_<|>0159¼²ª ") + ["\t", "'s", "'ll", "\xa0", "\x85", "\xad", "\x00", "<|endoftext|>"]
    segments = list(dict.fromkeys("".join(rng.choice(letters, int(rng.integers(1, 12)))) for _ in range(20_000)))
    segments = [s for s in segments if tokens.tokens.is_easy(s)]
    assert tokens.tokens.fast is not None and len(segments) > 5000
    fast = tokens.tokens.ids_a(segments, [])
    slow = tokens.tokens.ids_a([], segments)
    assert np.array_equal(fast[0], slow[0]) and np.array_equal(fast[1], slow[1])
