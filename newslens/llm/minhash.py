"""Near duplicates by MinHash with sequential Bayesian verification, exact on full sets.

1. One pass over the texts makes the set of distinct 2-word shingles (64-bit hashes), a digest of
   the set, a signature of ``BANDS * ROWS`` minima and the key of every band. Equal sets are one
   node from here on, so exact copies never meet each other.
2. Nodes that share a band are candidates. A comparison reads the signatures in batches and stops as
   soon as the posterior probability of the wanted similarity falls below ``MISS`` (BayesLSH). The
   components of the pairs that survive are families; every link lies inside one.
3. Members of a family are verified on full sets, and the components of the links are the result.

Neither step expands a group into all pairs. First every member of a bucket is compared with its first member (and
those of these pairs that survive are verified), which leaves few components. Then members outside the
largest component of a bucket or family are compared with all of it in packed blocks: m such members
among n take ``m * n / block ** 2`` rows, each of bounded size and each joined by its own key (group, left block, right
block), and a block pair returns no more links than it has members.

A link at the threshold shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 7e-7.

Defined results: null and empty texts, and texts without words, have 0 shingles and are linked with
nothing; a text of one word has that word as its only shingle. Rows with a null id are linked with
nothing and have a null component. Rows are told apart by their set, so repeated rows get repeated
results; several texts under one id are nodes of their own, linked only if they are similar, and each bears the id of
its own component. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.pretokens import chunks, mixing_table, segment_hashes, worker_state
from newslens.runtime import materialize

BANDS, ROWS = 27, 4
PERCENT = 80
BATCH = 12
MISS = 1e-7
BLOCK = 256  # signatures in a block
BLOCK_SHINGLES = 100_000  # shingles in a block of full sets
COLUMNS = 8192
_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _word_map() -> tuple[np.ndarray, np.ndarray]:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return table, inside


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that have words, where the set of each starts, and the distinct shingles, sorted per row."""
    table, inside = _word_map()
    mix = worker_state("minhash", ("word_mix",), mixing_table)

    def sets(rows: np.ndarray, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = owner[1:] == owner[:-1]
        two = mixed(words[:-1] * _GOLD + mixed(words[1:]))[pair]
        counts = np.bincount(owner, minlength=len(rows))
        alone = counts[owner] == 1
        of = np.concatenate([owner[:-1][pair], owner[alone]])
        shingles = np.concatenate([two, mixed(words[alone] + _GOLD)])
        order = np.lexsort((shingles, of))
        of, shingles = of[order], shingles[order]
        first = np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (shingles[1:] != shingles[:-1])
        of, shingles = of[first], shingles[first]
        present, starts = np.unique(of, return_index=True)
        return rows[present], starts, shingles

    open_row, held = -1, []
    for chunk in chunks(texts):
        keep = inside[chunk.data]
        data = table[chunk.data]
        begin = keep.copy()
        border = np.zeros(len(keep) + 1, bool)
        border[chunk.borders] = True
        begin[1:] &= ~keep[:-1] | border[1:-1]
        at = np.cumsum(keep) - 1  # place among the kept bytes
        starts = at[begin]
        kept = data[keep]
        lengths = np.diff(np.append(starts, len(kept)))
        words = segment_hashes(mix, kept, starts, lengths) if len(starts) else np.zeros(0, np.uint64)
        owner = np.searchsorted(chunk.borders, np.flatnonzero(begin), "right") - 1
        if held and chunk.rows[0] != open_row:
            w = np.concatenate(held)
            if len(w):
                yield sets(np.array([open_row]), np.zeros(len(w), np.int64), w)
            held = []
        if len(chunk.rows) == 1:  # maybe a part of a long text: its shingles cross the parts
            open_row = chunk.rows[0]
            held.append(words)
        elif len(words):
            yield sets(chunk.rows, owner, words)
    if held and len(w := np.concatenate(held)):
        yield sets(np.array([open_row]), np.zeros(len(w), np.int64), w)


def text_digest(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text_digest, n, digest, bands, sig)`` per row, stored; the last three are null without words."""
    k = BANDS * ROWS
    rng = np.random.default_rng(8)
    factor = rng.integers(0, 1 << 64, k, np.uint64) | np.uint64(1)
    shift = rng.integers(0, 1 << 64, k, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            digest, bands, sig = ([None] * batch.num_rows for _ in range(3))
            for rows, starts, shingles in shingle_sets(batch.column(2)):
                n = np.diff(np.append(starts, len(shingles)))
                count[rows] = n
                low = np.empty((len(rows), k), np.uint32)
                for j in range(k):
                    low[:, j] = np.minimum.reduceat((shingles * factor[j] + shift[j]) >> np.uint64(32), starts)
                sums = np.stack([np.add.reduceat(shingles, starts), np.add.reduceat(mixed(shingles + _GOLD), starts), n.astype(np.uint64)], 1)
                keys = np.tile(mixed(np.arange(BANDS, dtype=np.uint64)), (len(rows), 1))
                for r in range(ROWS):
                    keys = mixed(keys * _GOLD + low[:, r::ROWS].astype(np.uint64))
                short = low.astype(np.uint16)
                for i, row in enumerate(rows.tolist()):
                    digest[row], sig[row], bands[row] = sums[i].tobytes(), short[i].tobytes(), keys[i].view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(count), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_digest", "n", "digest", "bands", "sig"])

    whole = F.col(text).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_digest(whole).alias("text_digest"), whole.alias("text"))
    return materialize(rows.mapInArrow(run, "id bigint, text_digest binary, n bigint, digest binary, bands array<bigint>, sig binary"), "minhash")


@cache
def least_matches(size: int, percent: int = PERCENT, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """``(hashes compared, least matches)`` per batch.

    With m of n matches and an even prior, P(similarity >= t) is P(Binomial(n + 1, t) <= m); fewer
    matches than the least make that less than ``miss``.
    """
    t, out = percent / 100, []
    for n in [*range(BATCH, size, BATCH), size]:
        total, least = 0.0, 0
        for m in range(n + 2):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                least = m
                break
        out.append((n, least))
    return tuple(out)


def likely(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (rows ``a`` of left, ``b`` of right) survive all batches."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in least_matches(left.shape[1]):
        matches += (left[a[alive], done:n] == right[b[alive], done:n]).sum(axis=1, dtype=np.int32)
        go = matches >= least
        alive, matches, done = alive[go], matches[go], n
        if not len(alive):
            break
    return alive


def _signature_matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(-1, BANDS * ROWS)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """``(group, node, hub)`` of the buckets with at least two nodes, stored; the key of a band also says which band."""
    rows = nodes.select("node", F.explode("bands").alias("group"))
    hubs = rows.groupBy("group").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return materialize(rows.join(hubs, "group"), "buckets")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(node, shingles)`` of the nodes in ``wanted`` (``node, sid, digest``), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, digest = [b""] * batch.num_rows, [b""] * batch.num_rows
            for rows, starts, shingles in shingle_sets(batch.column(1)):
                ends = np.append(starts, len(shingles))
                sums = np.stack([np.add.reduceat(shingles, starts), np.add.reduceat(mixed(shingles + _GOLD), starts), np.diff(ends).astype(np.uint64)], 1)
                for i, row in enumerate(rows.tolist()):
                    packed[row], digest[row] = shingles[ends[i] : ends[i + 1]].tobytes(), sums[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], names=["sid", "digest", "shingles"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("sid"), F.col(text).cast("string").alias("text"))
    mine = texts.join(wanted.select("sid").distinct(), "sid", "left_semi")
    made = mine.mapInArrow(run, "sid bigint, digest binary, shingles binary").join(wanted, ["sid", "digest"])
    return materialize(made.groupBy("sid", "digest", "node").agg(F.first("shingles").alias("shingles")).select("node", "shingles"), "shingle-sets")


def likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.arange(batch.num_rows)
            kept = likely(_signature_matrix(batch.column(2)), _signature_matrix(batch.column(3)), index, index)
            yield batch.select(["a", "b"]).take(pa.array(kept))

    sigs = nodes.select("node", "sig")
    left = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = left.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(a) + len(b) - len(np.union1d(a, b)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                if 100 * both >= percent * (len(a) + len(b) - both):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint"), "links")


def components(edges: DataFrame) -> DataFrame | None:
    """``(node, root)`` of every node of the edges ``(a, b)``, stored; None without edges.

    Each round every node goes to the first of its neighbours and itself, and the edges that are left join the places they
    went to. First is the smallest in even rounds, which ends a star at once, and by a hash of the round in odd
    ones, which ends a chain in logarithmic time.
    """
    edges, labels, turn = edges.filter("a <> b").distinct(), None, 0
    while True:
        edges = materialize(edges, "edges")
        if edges.isEmpty():
            return labels
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = (lambda c: F.xxhash64(F.col(c), F.lit(turn))) if turn % 2 else F.col
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("order"), F.col("b").alias("node"))).alias("first"))
        place = F.least(F.col("first"), F.struct(order("a").alias("order"), F.col("a").alias("node")))
        went = materialize(first.select(F.col("a").alias("node"), place["node"].alias("root")), "places")
        moved = edges.join(went.withColumnsRenamed({"node": "a", "root": "u"}), "a").join(went.withColumnsRenamed({"node": "b", "root": "v"}), "b")
        edges = moved.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        if labels is None:
            labels = went
        else:
            labels = materialize(labels.withColumnRenamed("root", "at").join(went.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("root", "at").alias("root")), "roots")
        turn += 1


def joined(labels: DataFrame | None, more: DataFrame) -> DataFrame | None:
    """Components of what ``labels`` stands for and the links ``more`` between them: only the few new links are contracted."""
    if labels is None or more.isEmpty():
        return components(more) if labels is None else labels
    ends = more.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(labels.withColumnsRenamed({"node": end, "root": "root"}), end, "left").withColumn(f"_{end}", F.coalesce("root", end)).drop("root")
    new = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    if new is None:
        return labels
    lone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(lone.select("node", F.col("node").alias("root")))
    return materialize(every.withColumnRenamed("root", "at").join(new.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("root", "at").alias("root")), "roots")


def _labelled(groups: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``(group, node, comp)`` of the groups that hold more than one component, stored."""
    if roots is None:
        named = groups.select("group", "node", F.col("node").alias("comp"))
    else:
        named = groups.join(roots, "node", "left").select("group", "node", F.coalesce("root", "node").alias("comp"))
    several = named.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    return materialize(named.join(several.select("group"), "group", "left_semi"), "mixed-groups")


def _block_rows(members: DataFrame, payload: DataFrame, weight: str, limit: int) -> DataFrame:
    """``(lefts, rights)``: blocks of members outside their group's largest component, against blocks of all.

    ``payload`` has ``node``, ``data`` and the weight; a block holds about ``limit`` of the weight. Pairs of blocks are
    joined by (group, left, right), so those of one group are spread over all tasks.
    """
    placed = members.join(payload, "node")
    sizes = placed.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum(weight).alias("weight"))
    most = sizes.groupBy("group").agg(F.max(F.struct("size", "comp", "weight")).alias("most"), F.sum("weight").alias("all"))
    blocks = {"left": F.col("all") - F.col("most.weight"), "right": F.col("all")}
    most = most.select("group", F.col("most.comp").alias("largest"), *[F.ceil(x / F.lit(limit)).cast("bigint").alias(f"n_{c}") for c, x in blocks.items()])
    placed = placed.join(most, "group")

    def packed(rows: DataFrame, own: str, other: str) -> DataFrame:
        slot = F.pmod(F.xxhash64("node"), F.col(f"n_{own}"))
        block = rows.groupBy("group", slot.alias(own), f"n_{other}").agg(F.collect_list(F.struct("node", "comp", "data")).alias(f"{own}s"))
        return block.select("group", own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}") - 1)).alias(other), f"{own}s")

    lefts = packed(placed.filter(F.col("comp") != F.col("largest")), "left", "right")
    return lefts.join(packed(placed, "right", "left"), ["group", "left", "right"]).select("lefts", "rights")


def _sides(batch: pa.RecordBatch, i: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    for c in (0, 1):
        entries = batch.column(c)[i].values
        yield entries.field("node").to_numpy(), entries.field("comp").to_numpy(), entries.field("data")


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a bipartite link matrix."""
    edges, left_open, right_open = [], linked.any(axis=1), linked.any(axis=0)
    while left_open.any():
        front = np.array([int(left_open.argmax())])
        left_open[front] = False
        while len(front):
            reach = linked[front] & right_open
            new = np.flatnonzero(reach.any(axis=0))
            edges += zip(front[reach[:, new].argmax(axis=0)].tolist(), new.tolist())
            right_open[new] = False
            back = linked[:, new] & left_open[:, None]
            front = np.flatnonzero(back.any(axis=1))
            edges += zip(front.tolist(), new[back[front].argmax(axis=1)].tolist() if len(front) else [])
            left_open[front] = False
    return edges


def _linked_ids(ids: list[np.ndarray], linked: np.ndarray) -> pa.RecordBatch:
    edges = np.array(spanning(linked), np.int64).reshape(-1, 2)
    p, q = ids[0][edges[:, 0]], ids[1][edges[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])


def likely_in_blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of what the signatures do not rule out, across components; a spanning forest per block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (left, left_comp, x), (right, right_comp, y) = _sides(batch, i)
                x, y = _signature_matrix(x), _signature_matrix(y)
                linked = np.zeros((len(left), len(right)), bool)
                for begin in range(0, len(left), 64):
                    p, q = np.nonzero(left_comp[begin : begin + 64, None] != right_comp[None])
                    kept = likely(x, y, p + begin, q)
                    linked[p[kept] + begin, q[kept]] = True
                yield _linked_ids([left, right], linked)

    payload = nodes.select("node", F.col("sig").alias("data"), F.lit(1).alias("one"))
    return materialize(_block_rows(members, payload, "one", BLOCK).mapInArrow(run, "a bigint, b bigint").distinct(), "likely")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as matrix products over slices of the shingles."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    every, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    cuts = np.searchsorted(place, np.arange(0, len(every) + COLUMNS, COLUMNS))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        table = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        table[owner[part], place[part] - k * COLUMNS] = 1
        total += table[: len(left)] @ table[len(left) :].T
    return total.astype(np.int64)


def verified_in_blocks(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links on full sets across components, a spanning forest per block pair, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (left, left_comp, x), (right, right_comp, y) = _sides(batch, i)
                x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in side] for side in (x, y))
                both = shared_counts(x, y)
                union = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None] - both
                yield _linked_ids([left, right], (100 * both >= percent * union) & (left_comp[:, None] != right_comp[None]))

    payload = sets.select("node", F.col("shingles").alias("data"), (F.octet_length("shingles") / 8).alias("size_of"))
    return materialize(_block_rows(members, payload, "size_of", BLOCK_SHINGLES).mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text_digest, n, component, group)`` for every row of ``docs``.

    ``group`` numbers the components, also where two bear the same smallest id; it is null for rows without id or words.
    """
    rows = signatures(docs, id_col, text)
    usable = rows.filter("id is not null and digest is not null")
    nodes = usable.groupBy("digest").agg(F.min(F.struct("id", "bands", "sig")).alias("x"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), F.col("x.id").alias("sid"), "digest", "x.bands", "x.sig"), "nodes")
    members = shared_buckets(nodes)
    star = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = materialize(likely_pairs(star, nodes), "likely")
    alike = components(near)
    families = joined(alike, likely_in_blocks(_labelled(members, alike), nodes))
    roots = None
    if families is not None:
        wanted = nodes.select("node", "sid", "digest").join(families.select("node"), "node", "left_semi")
        sets = full_sets(docs, wanted, id_col, text)
        linked = components(verified(near, sets))
        groups = families.withColumnRenamed("root", "group")
        roots = joined(linked, verified_in_blocks(_labelled(groups, linked), sets))
    classes = nodes.select("node", "sid", "digest")
    if roots is None:
        classes = classes.select("digest", F.col("sid").alias("component"), F.col("node").alias("group"))
    else:
        classes = classes.join(roots, "node", "left").select("digest", "sid", F.coalesce("root", "node").alias("group"))
        least = classes.groupBy("group").agg(F.min("sid").alias("component"))
        classes = classes.join(least, "group").select("digest", "component", "group")
    narrow = rows.select("id", "text_digest", "n", "digest")
    linked = narrow.filter("id is not null and digest is not null").join(classes, "digest").drop("digest")
    alone = narrow.filter("id is null or digest is null").select("id", "text_digest", "n", F.col("id").alias("component"), F.lit(None).cast("bigint").alias("group"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``."""
    return grouped(docs, id_col, text).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op8_query(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
