"""Filter interactions against a plain per-document loop over all orders."""

import re
from itertools import permutations

import numpy as np

from newslens.llm import filter_audit as fa

SCHEMA = "doc_id bigint, text string, lang string, MASK string, n string"


def plain_failures(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    out = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and doc_id > first[text]:
            fails.add("E")
        out.append((lang or "", doc_id, fails))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    docs = plain_failures(rows)
    out = {}
    for part in {p for p, _, _ in docs}:
        mine = [(i, f) for p, i, f in docs if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                earlier = sum(name in f and bool(f & set(order[: step - 1])) for _, f in mine)
                out[part, order, step] = [len(left), len(gone), earlier, sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                removed_by[name] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                out[part, order, step].append(removed_by[name])
    return out


def spark_audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = fa.audit(docs, marks).collect()
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got}
    assert len(out) == len(got)
    return out


def test_equals_a_loop_over_documents(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "Gamma", "DELTA", "e#", "été", " x", "zeta"]
    texts = [" ".join(rng.choice(words, int(k))) for k in rng.integers(0, 30, 12)]
    texts += [" ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "\t\n", "", None, "a\x0bb\x0cc " * 70]
    rows = [(int(rng.integers(0, 60)), texts[int(rng.integers(0, len(texts)))], [None, "", "en", "de"][int(rng.integers(0, 4))]) for _ in range(160)]
    rows += [(None, texts[0], "en"), (None, None, None), (7, texts[1], "en"), (7, texts[1], "en")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 60, 3)] + [(6, 1, None), (6, 0, 1), (None, 1, 1), (9, None, None)]
    assert spark_audit(spark, rows, labels) == plain_audit(rows, labels)


def test_a_text_of_most_rows_and_a_very_long_one(spark):
    long = "word " * 400_000
    rows = [(i, "the same text again and again", "en") for i in range(3000)] + [(5000, long, "en"), (5001, long, "de")]
    assert spark_audit(spark, rows, [(1, 1, 0)]) == plain_audit(rows, [(1, 1, 0)])


def test_no_rows_no_parts(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert fa.audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_ranks_are_the_first_failing_position():
    ranks = fa.removal_ranks()
    for o, order in enumerate(fa.ORDERS):
        for mask in range(fa.MASKS):
            fails = [order.index(f) for k, f in enumerate(fa.FILTERS) if mask >> k & 1]
            assert ranks[o, mask] == min(fails, default=fa.KEPT)
