import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newslens.functions.hashing import simhash64
from newslens.functions.scalars import hamming
from newslens.operators import neardup as nd
from newslens.operators import ordering
from newslens.operators import splits as sp
from newslens.runtime import materialize


def plain_simhash(text):
    votes = [0] * 64
    for t in text.lower().split():
        h = int(hashlib.md5(t.encode()).hexdigest(), 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    sig = sum(1 << i for i, v in enumerate(votes) if v > 0)
    return sig - (1 << 64) if sig >> 63 else sig


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {n: root(n) for n in nodes}


def clustered(n, seed, flips=3):
    """Signatures around few centres, so many lie within a few bits of each other."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        s = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            s ^= 1 << rng.randrange(64)
        out.add(s - (1 << 64) if s >> 63 else s)
    return sorted(out)


def brute_pairs(sigs, bits):
    return {(a, b) for i, a in enumerate(sigs) for b in sigs[i + 1 :] if distance(a, b) <= bits}


def found_pairs(spark, sigs, bits):
    df = nd.near_pairs(spark.createDataFrame([(s,) for s in sigs], "sig bigint"), bits)
    rows = [(r.sig_a, r.sig_b) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_simhash(spark):
    texts = ["this is a test", "this is a test", "this is another test", "", "a b", "Élan Vital élan"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", simhash64("t").alias("s")).collect()
    assert [r.s for r in sorted(rows)] == [plain_simhash(t) for t in texts]
    assert rows[0].s == rows[1].s != rows[2].s
    df = spark.createDataFrame([(rows[0].s, rows[2].s)], "a bigint, b bigint")
    assert df.select(hamming(F.col("a"), F.col("b"))).first()[0] == distance(rows[0].s, rows[2].s) > 0


@pytest.mark.parametrize("bits", [1, 3, 5, 7])
def test_pairs_equal_brute_force(spark, bits):
    sigs = clustered(300, bits)
    assert found_pairs(spark, sigs, bits) == brute_pairs(sigs, bits)


def test_overfull_buckets_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(nd, "MAX_BUCKET", 20)
    monkeypatch.setattr(ordering, "MIN_HOT_ROWS", 10)
    monkeypatch.setattr(ordering, "HOT_SHARE", 20)
    sigs = clustered(300, 11)
    assert found_pairs(spark, sigs, 3) == brute_pairs(sigs, 3)


def test_last_level_is_bounded():
    for n in (10, 10**6, 10**10):
        levels = nd.key_levels(n, 3)
        assert levels == sorted(levels) and 64 * 3 / levels[-1] <= 12
        assert all(nd.comb(m, 3) <= nd.MAX_COPIES for m in levels)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in nd.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MIN_HOT_ROWS", 5)
    monkeypatch.setattr(ordering, "HOT_SHARE", 20)
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, i) for i in range(501, 560)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in nd.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == components(nodes, edges)


def test_groups_of_three_texts(spark):
    df = spark.createDataFrame([("1", "this is a test"), ("2", "this is a test"), ("3", "this is another test")], "id string, text string")
    assert {r.id: r.group_id for r in nd.near_duplicate_groups(df, "id", max_bits=1).collect()} == {"1": "1", "2": "1", "3": "3"}


@pytest.mark.parametrize("hot", [False, True])
def test_groups_equal_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(ordering, "MIN_HOT_ROWS", 5)
        monkeypatch.setattr(ordering, "HOT_SHARE", 10)
    rng = random.Random(2)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=120)) for _ in range(30)]
    rows = []
    for i in range(150):
        words = rng.choice(base[:3] if i % 3 == 0 else base).split()
        if i % 2:
            words[rng.randrange(120)] = "changed"
        rows.append((i, " ".join(words)))
    sig = {i: plain_simhash(t) for i, t in rows}
    pairs = [(a, b) for a in sig for b in sig if a < b and distance(sig[a], sig[b]) <= 3]
    df = spark.createDataFrame(rows, "id int, text string")
    want = components(list(sig), pairs)
    assert {r.id: r.group_id for r in nd.near_duplicate_groups(df, "id").collect()} == want
    assert {r.id: r.group_id for r in nd.near_duplicate_groups(df.repartition(5), "id").collect()} == want


def articles(spark, n):
    return spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(n)], "id int, text string, label int")


def test_split_counts(spark):
    rows = sp.stratified_splits(articles(spark, 20), (42,), ratio=(0.6, 0.2, 0.2), dedupe=False).collect()
    counts = defaultdict(int)
    for r in rows:
        counts[r.split] += 1
    assert abs(counts["train"] - 12) <= 1 and abs(counts["val"] - 4) <= 1 and abs(counts["test"] - 4) <= 1
    assert len(rows) == len({r.id for r in rows}) == 20


def test_splits_keep_groups_whole_and_balanced(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MIN_HOT_ROWS", 20)
    monkeypatch.setattr(ordering, "HOT_SHARE", 10)
    groups = spark.createDataFrame([(i, 0 if i < 100 else i) for i in range(300)], "id int, group_id int")
    df = articles(spark, 300)
    rows = sp.stratified_splits(df, (13, 17), groups=groups).collect()
    assert len(rows) == 600
    for seed in (13, 17):
        mine = [r for r in rows if r.seed == seed]
        assert len({r.split for r in mine if r.group_id == 0}) == 1
        per_class = defaultdict(int)
        for r in mine:
            if r.group_id:
                per_class[(r.split, r.id % 2)] += 1
        for split, share in (("train", 0.64), ("val", 0.16), ("test", 0.2)):
            assert abs(per_class[(split, 0)] - share * 100) <= 2 and abs(per_class[(split, 1)] - share * 100) <= 2
    again = sp.stratified_splits(df.repartition(9), (13, 17), groups=groups).collect()
    assert sorted(rows) == sorted(again)
    assert {r.id for r in rows if r.seed == 13 and r.split == "test"} != {r.id for r in rows if r.seed == 17 and r.split == "test"}


def test_quotas_and_seeds(spark):
    assert sp.class_shares({0: 5, 1: 5}, 5) == {0: 3, 1: 2}
    assert sp.split_quotas({0: 10, 1: 10}, (0.6, 0.2, 0.2)) == {0: (2, 2), 1: (2, 3)}  # 1 - 0.6 / 0.8 is a little over 1/4
    with pytest.raises(ValueError):
        sp.stratified_splits(articles(spark, 4), (1,), n_splits=2)


def test_majority_and_tie(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1), ("b", 0)], "group_id string, label int")
    assert {r.group_id: r.label for r in sp.group_labels(df).collect()} == {"a": 0, "b": 1}


def test_profile_lists_empty_splits(spark):
    df = spark.createDataFrame([(1, "One two. Three", 0), (2, "One", 1)], "id int, text string, label int")
    splits = spark.createDataFrame([(13, 1, 1, "train"), (13, 2, 2, "train")], "seed int, id int, group_id int, split string")
    rows = {r.split: r for r in sp.split_profile(splits, df).collect()}
    t = rows["train"]
    assert (t.n_articles, t.pct_fake, t.median_tokens, t.median_sentences) == (2, 50.0, 2, 1)
    assert (rows["val"].n_articles, rows["val"].pct_fake, rows["test"].median_tokens) == (0, 0.0, 0)


def test_banded_pairs_by_blocks_of_signatures(spark, monkeypatch):
    """All signatures share a band, so a bucket holds them all; blocks still bound what a task compares."""
    monkeypatch.setattr(nd, "SIG_BLOCK", 17)
    monkeypatch.setattr(nd, "STRIP", 40)
    rng = random.Random(9)
    sigs = sorted({(0x5A << 56 | sum(1 << b for b in rng.sample(range(56), rng.randint(0, 6)))) for _ in range(150)} | {-1, 0, (1 << 8) - 1, -(1 << 63)})
    shared = lambda a, b: any((a ^ b) >> (8 * i) & 0xFF == 0 for i in range(8))
    for bits in (8, 11):
        df = nd.near_pairs(spark.createDataFrame([(s,) for s in sigs] + [(None,)], "sig bigint"), bits)
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b, distance(a, b)) for a, b in brute_pairs(sigs, bits) if shared(a, b)}
    assert nd.near_pairs(spark.createDataFrame([], "sig bigint"), 8).count() == 0


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_split_plans_are_not_broadcast(spark, monkeypatch):
    """Their stored table is small, but seven seeds a group are not; only the few hot keys may go through the driver."""
    plan = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit("train").alias("split")) for s in (13, 17)])
    rows = materialize(spark.range(400).select("id", (F.col("id") % 40).alias("group_id")), "rows")
    plans = materialize(spark.range(40).select(F.col("id").alias("group_id"), F.lit(10).alias("n"), plan.alias("plan")), "plans")
    for hot, many in ((ordering.MIN_HOT_ROWS, 0), (5, 1)):
        monkeypatch.setattr(ordering, "MIN_HOT_ROWS", hot)
        got = ordering.attach(rows, plans, "group_id", ["plan"], "n", 400, ["id"])
        assert broadcasts(got) == many
        assert sorted((r.id, len(r.plan)) for r in got.collect()) == [(i, 2) for i in range(400)]


def test_keys_of_signatures_are_not_broadcast(spark):
    """A row per key leaves ``explode``, which Spark's estimate of the stored signatures leaves out."""
    rng = random.Random(4)
    sigs = {rng.getrandbits(63) for _ in range(60)}
    sigs |= {s ^ 1 << rng.randrange(60) for s in list(sigs)[:20]}
    nodes = materialize(spark.createDataFrame([(s,) for s in sigs], "sig bigint"), "few-nodes")
    pairs = nd.near_pairs(nodes, 3)
    assert broadcasts(pairs) == 0
    assert {tuple(r) for r in pairs.collect()} == {(a, b, distance(a, b)) for a, b in brute_pairs(sorted(sigs), 3)}


def test_whole_splits_broadcast_constants_only(spark, monkeypatch):
    """What is written on the way to the splits: no plan sends a table of rows or groups through the driver."""
    sent = []
    for at in (nd, sp):
        monkeypatch.setattr(at, "materialize", lambda df, tag, f=at.materialize: sent.append((tag, broadcasts(df))) or f(df, tag))
    df = materialize(articles(spark, 30), "few-articles")
    out = sp.stratified_splits(df, (13, 17))
    assert {t for t, n in sent if n} <= {"group-splits"}  # quotas and cuts: a few rows
    assert broadcasts(out) == 0 and out.count() == 2 * df.count()
