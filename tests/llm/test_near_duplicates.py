"""MinHash groups against all pairs on full sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from newslens.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(tuple([x]) for x in w)


def brute(rows):
    sets = {}
    for i, t in rows:
        s = shingles(t)
        if s and i is not None:
            sets.setdefault(s, []).append(i)
    keys, root = list(sets), {}
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if 100 * both >= 80 * (len(keys[a]) + len(keys[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for k, s in enumerate(keys):
        groups.setdefault(find(k), []).extend(sets[s])
    for g in groups.values():
        root |= {i: min(g) for i in g}
    return root


def family_rows(seed=3, families=12, members=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(members):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 8))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    texts += [None, "", " \t\n", "one", "ONE", "one ", "two words", "TWO words", "two words words", "É é", "é é", "x " * 5]
    texts += [texts[0].upper(), texts[0].replace(" ", "\x0b\n"), " ".join(rng.choice(vocab) for _ in range(60_000))]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [256, 16])
def test_groups_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200 * block)
    rows = family_rows()
    rows += [rows[0], (None, rows[0][1]), (None, None)]  # a repeated row, null ids
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n int, component_id string")
    got = minhash.near_duplicates(docs.repartition(4)).collect()
    root = brute(rows)
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in rows)
    size = {i: len(shingles(t)) for i, t in rows if i is not None}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            want = root.get(r.doc_id, r.doc_id)
            assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], want, want == r.doc_id)


def test_chain_of_near_copies_is_one_group(spark):
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 150])) for i in range(20)]  # only neighbours are similar enough
    assert len(set(brute(rows).values())) == 1
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_texts_under_one_id_are_nodes_of_their_own(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " x"), (5, a), (4, "c d")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (8, 5), (4, 4)}
    groups = minhash.grouped(spark.createDataFrame(rows, "doc_id bigint, text string")).select("id", "group").distinct().collect()
    assert len({r.group for r in groups}) == 3 and {r.group for r in groups if r.id == 7} != {r.group for r in groups if r.id == 8}


def test_a_family_of_thousands(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(5000):  # two words changed: any two copies are similar enough
        t = list(base)
        for _ in range(2):
            t[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((i + 10, " ".join(t)))
    rows += [(9000 + i, " ".join(f"u{i}_{k}" for k in range(30))) for i in range(500)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert all(got[i] == (10 if i < 9000 else i) for i, _ in rows)


def test_pairs_of_blocks_are_joined_by_their_own_key(spark):
    members = spark.range(200).selectExpr("0L as group", "id as node", "if(id < 150, 0L, id) as comp")
    payload = spark.range(200).selectExpr("id as node", "id as data", "1 as one")
    got = minhash._block_rows(members, payload, "one", 16).collect()
    met = {(x.node, y.node) for r in got for x in r.lefts for y in r.rights}
    assert met == {(x, y) for x in range(150, 200) for y in range(200)} and len(got) == 4 * 13


def test_components_of_a_chain_a_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got) == {*range(100, 161), *range(7, 60), 200, 201}
    for group in (range(100, 161), range(7, 60), (200, 201)):
        assert len({got[i] for i in group}) == 1 and got[group[0]] in group
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")) is None


def test_no_rows_and_no_links(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(empty).count() == 0
    two = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, None)], empty.schema)
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(two).collect()} == {(1, 1, True), (2, 2, True), (3, 3, True)}


def test_long_text_in_parts_has_the_same_set(monkeypatch):
    text = " ".join(f"Word{i % 977} and{i % 13}" for i in range(9000))
    whole = [s for _, _, s in minhash.shingle_sets(pa.array([text, "a b"]))]
    parts = minhash.chunks
    monkeypatch.setattr(minhash, "chunks", lambda t: parts(t, 4000))
    cut = [s for _, _, s in minhash.shingle_sets(pa.array([text, "a b"]))]
    assert len(np.setxor1d(np.concatenate(whole), np.concatenate(cut))) == 0
    assert len(cut[0]) == len(shingles(text))


def test_pruning_bound_keeps_what_is_similar():
    for n, least in minhash.least_matches(minhash.BANDS * minhash.ROWS):
        draws = np.random.default_rng(n).binomial(n, 0.8, 200_000)
        assert (draws < least).mean() <= 1e-5


def test_spanning_forest_connects_what_is_linked():
    rng = np.random.default_rng(2)
    for _ in range(50):
        linked = rng.random((7, 9)) < 0.15
        edges = minhash.spanning(linked)
        label = list(range(16))
        for x, y in edges:
            assert linked[x, y]
            old, new = label[7 + y], label[x]
            label = [new if v == old else v for v in label]
        assert all(label[x] == label[7 + y] for x, y in zip(*np.nonzero(linked))) and len(edges) <= 15
