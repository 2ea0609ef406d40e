"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors are one node. Nodes travel in the precision of the table, and whatever is kept or cut is ranked by
sums of squared differences in double precision, so near copies keep their order however close they are.

* Start: nodes fall into leaves of about ``LEAF`` by the signs of random projections, ``TREES``
  times; overfull leaves are split at random. Each leaf compares its members.
* A round of NN-descent: every node gathers its neighbours and at most ``REVERSE`` nodes that have it as
  neighbour, with their vectors; pairs of those with at least one new entry are compared in the task, and
  what is nearer than a node's farthest neighbour is offered to it. Offers fall into hash slots with one
  minimum each, combined before the shuffle, so a node that is everybody's neighbour gathers
  no more than ``SLOTS`` offers. Rounds end when few entries are new.
* Search: each query starts at its own node and repeatedly expands all nodes among its ``BEAM`` nearest
  that are not expanded yet, one join per round for all queries.

The graph is approximate by design, so recall is measured: see the tests and the README.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; of rows with equal id and vector one takes part. With fewer than ``k`` candidates
all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.runtime import materialize

NEIGHBOURS = 28
REVERSE = 28
SLOTS = 512
OFFERS = 8
LEAF = 128
TREES = 3
ROUNDS = 5
STILL = 0.05  # rounds end when this share of the entries is new, or less
BEAM = 160
SEARCH_ROUNDS = 8
K = 10
EDGES = "u bigint, v bigint, d double"
DOUBT = 1e-7  # share of the squared norms below which products lose too many digits
PAIRS = 1 << 15


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` of the vectors that take part, doubled rows once."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
    good = good.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    good = good.filter(finite & F.exists("vec", lambda x: x != 0))
    sizes = good.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "size"))["size"]).first()[0]
    return good.filter(F.size("vec") == F.lit(most or 0)).distinct()


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _list_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nodes_of(good: DataFrame, most: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """``(node, vec, packed)`` of the distinct vectors and ``(node, id)`` of their smallest ``most`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = pa.array([x.tobytes() for x in _list_matrix(batch.column(1)).astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=["node", "vec", "packed"])

    distinct = good.groupBy("vec").agg(F.min("id").alias("node")).select("node", "vec")
    nodes = materialize(distinct.mapInArrow(run, "node bigint, vec array<double>, packed binary"), "nn-nodes")
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    first = good.withColumn("rank", rank).filter(F.col("rank") <= most)
    named = first.withColumn("node", F.min("id").over(Window.partitionBy("vec")))
    return nodes, materialize(named.select("node", "id"), "nn-members")


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows by their differences, the same to the last bit in both directions."""
    out = np.empty(len(x))
    for i in range(0, len(x), PAIRS):
        step = x[i : i + PAIRS].astype(np.float64) - y[i : i + PAIRS]
        out[i : i + PAIRS] = (step * step).sum(axis=1)
    return out


def _distances(vec: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Squared distances inside stacked matrices, infinite where not wanted.

    They come from products relative to the first row; pairs so near that those lose digits are taken by differences.
    """
    x = vec.astype(np.float64)
    x -= x[:, :1]
    a = (x * x).sum(axis=-1)
    both = a[:, :, None] + a[:, None, :]
    d = both - 2 * (x @ np.swapaxes(x, 1, 2))
    i, j, k = np.nonzero(wanted & ~(d > DOUBT * both))
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        d[i[part], j[part], k[part]] = _squares(vec[i[part], j[part]], vec[i[part], k[part]])
    d[~wanted] = np.inf
    return d


def _offers(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d.astype(np.float64))], names=["u", "v", "d"])


def leaf_offers(nodes: DataFrame, count: int, kind: str, trees: int) -> DataFrame:
    """Near pairs inside random-projection leaves, in both directions."""
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / (4 * LEAF))))) + 2 if count > 4 * LEAF else 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = _matrix(batch.column(1), kind)
            for tree in range(trees):
                normal = np.random.default_rng(tree).normal(size=(vec.shape[1], max(bits, 1)))
                leaf = ((vec @ normal > 0) @ (1 << np.arange(max(bits, 1)))).astype(np.int64) * (bits > 0)
                tag = pa.array(np.full(batch.num_rows, tree, np.int32))
                yield pa.RecordBatch.from_arrays([tag, pa.array(leaf), *batch.columns], names=["tree", "leaf", "node", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.column(0):
                members = entry.values
                ids = members.field("node").to_numpy()
                vec = _matrix(members.field("packed"), kind)
                keep = min(NEIGHBOURS, len(ids) - 1)
                if keep < 1:
                    continue
                d = _distances(vec[None], ~np.eye(len(ids), dtype=bool)[None])[0]
                near = np.argpartition(d, keep - 1, axis=1)[:, :keep].ravel()
                of = np.repeat(np.arange(len(ids)), keep)
                yield _offers(ids[of], ids[near], _squares(vec[of], vec[near]))

    placed = nodes.select("node", "packed").mapInArrow(place, "tree int, leaf bigint, node bigint, packed binary")
    sizes = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    parts = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / (2 * LEAF)))
    blocks = placed.join(sizes, ["tree", "leaf"]).withColumn("part", parts).groupBy("tree", "leaf", "part")
    return blocks.agg(F.collect_list(F.struct("node", "packed")).alias("members")).select("members").mapInArrow(compare, EDGES)


def nearest_offers(offers: DataFrame, turn: int) -> DataFrame:
    """``(u, v, d, new)``: the nearest neighbours of each node among its offers, stored."""
    slot = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(SLOTS))
    least = offers.groupBy("u", slot.alias("slot")).agg(F.min(F.struct("d", "v", "new")).alias("o"))
    lists = least.groupBy("u").agg(F.slice(F.sort_array(F.collect_list("o")), 1, NEIGHBOURS).alias("os"))
    return materialize(lists.select("u", F.explode("os").alias("o")).select("u", "o.v", "o.d", "o.new"), "nn-graph")


def reversed_edges(graph: DataFrame, turn: int) -> DataFrame:
    """At most ``REVERSE`` of the nodes that have u as neighbour, one per hash slot."""
    slot = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(REVERSE))
    back = graph.groupBy("v", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("u", F.lit(-turn)).alias("h"), "u", "new")).alias("o"))
    return back.select(F.col("v").alias("u"), F.col("o.u").alias("v"), F.col("o.new").alias("new"))


def descent_offers(graph: DataFrame, nodes: DataFrame, turn: int, kind: str) -> DataFrame:
    """One round: offers between neighbours of each node that are nearer than the farthest neighbour they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                lists = batch.column(0).slice(begin, 256)
                sizes = lists.value_lengths().to_numpy()
                entries = lists.flatten()
                width, n = int(sizes.max()), len(lists)
                row = np.repeat(np.arange(n), sizes)
                col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                flat = _matrix(entries.field("packed"), kind)
                vec = np.zeros((n, width, flat.shape[1]), kind)
                kth = np.zeros((n, width))
                ids, new = np.full((n, width), -1), np.zeros((n, width), bool)
                vec[row, col] = flat
                kth[row, col] = entries.field("far").to_numpy()
                ids[row, col] = entries.field("v").to_numpy()
                new[row, col] = entries.field("new").to_numpy(zero_copy_only=False)
                open_pair = (new[:, :, None] | new[:, None, :]) & (ids[:, :, None] != ids[:, None, :]) & (ids[:, None, :] >= 0)
                d = _distances(vec, open_pair)
                d[~(d < kth[:, :, None])] = np.inf
                keep = min(OFFERS, width)
                near = np.argpartition(d, keep - 1, axis=2)[:, :, :keep]
                best = np.take_along_axis(d, near, 2)
                x, y, z = np.nonzero(np.isfinite(best))
                other = near[x, y, z]
                exact = _squares(vec[x, y], vec[x, other])
                nearer = exact < kth[x, y]
                yield _offers(ids[x, y][nearer], ids[x, other][nearer], exact[nearer])

    far = graph.groupBy("u").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n"))
    far = far.select(F.col("u").alias("node"), F.when(F.col("n") < NEIGHBOURS, F.lit(float("inf"))).otherwise(F.col("far")).alias("far"))
    known = nodes.select("node", "packed").join(far, "node", "left")
    known = known.select(F.col("node").alias("v"), "packed", F.coalesce("far", F.lit(float("inf"))).alias("far"))
    around = graph.select("u", "v", "new").unionByName(reversed_edges(graph, turn)).groupBy("u", "v").agg(F.max("new").alias("new"))
    met = around.join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "new", "packed", "far")).alias("entries"), F.max("new").alias("any"))
    return met.filter("any").select("entries").mapInArrow(run, EDGES)


def build_graph(nodes: DataFrame, kind: str, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph ``(u, v, d, new)``."""
    count = nodes.count()
    graph = nearest_offers(leaf_offers(nodes, count, kind, TREES).withColumn("new", F.lit(True)), 0)
    for turn in range(1, rounds + 1):
        offered = descent_offers(graph, nodes, turn, kind).withColumn("new", F.lit(True))
        graph = nearest_offers(offered.unionByName(graph.withColumn("new", F.lit(False))), turn)
        fresh, every = graph.agg(F.sum(F.col("new").cast("int")), F.count(F.lit(1))).first()
        if (fresh or 0) <= STILL * every:
            break
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, kind: str, beam: int = BEAM, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """``(q, v)``: up to ``beam`` of the nodes found nearest to each query node ``q``, itself included."""
    both = graph.select("u", "v").unionByName(reversed_edges(graph, 0).select("u", "v")).distinct()
    links = materialize(both, "nn-links")
    packed = nodes.select(F.col("node").alias("v"), "packed")
    asked = queries.select(F.col("node").alias("q")).distinct().join(nodes.select(F.col("node").alias("q"), F.col("packed").alias("q_packed")), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for i in range(batch.num_rows):
                q = batch.column(0)[i].as_py()
                q_vec = np.frombuffer(batch.column(1)[i].as_buffer(), kind)[None]
                had, came = batch.column(2)[i].values, batch.column(3)[i].values
                v = [had.field("v").to_numpy()]
                d = [had.field("d").to_numpy()]
                done = [had.field("done").to_numpy(zero_copy_only=False)]
                if len(came):
                    v.append(came.field("v").to_numpy())
                    d.append(_squares(_matrix(came.field("packed"), kind), np.broadcast_to(q_vec, (len(came), q_vec.shape[1]))))
                    done.append(np.zeros(len(came), bool))
                v, d, done = np.concatenate(v), np.concatenate(d), np.concatenate(done)
                order = np.lexsort((v, d))[:beam]
                for held, x in zip(out, (np.full(len(order), q), v[order], d[order], done[order])):
                    held.append(x)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["q", "v", "d", "done"])

    state = asked.select("q", F.col("q").alias("v"), F.lit(0.0).alias("d"), F.lit(False).alias("done"))
    state = materialize(state, "nn-search")
    nothing_came = F.array().cast("array<struct<v:bigint,packed:binary>>")
    for _ in range(rounds):
        front = state.filter("not done")
        if front.isEmpty():
            break
        reached = front.select("q", F.col("v").alias("u")).join(links, "u").select("q", "v").distinct()
        reached = reached.join(state.select("q", "v"), ["q", "v"], "left_anti")
        came = reached.join(packed, "v").groupBy("q").agg(F.collect_list(F.struct("v", "packed")).alias("came"))
        had = state.groupBy("q").agg(F.collect_list(F.struct("v", "d", F.lit(True).alias("done"))).alias("had"))
        met = asked.join(had, "q").join(came, "q", "left").select("q", "q_packed", "had", F.coalesce("came", nothing_came).alias("came"))
        state = materialize(met.mapInArrow(run, "q bigint, v bigint, d double, done boolean"), "nn-search")
    return state.select("q", "v")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row for which ``is_query`` holds (a column of ``id``)."""
    good = materialize(usable(vectors, id_col, vec_col), "nn-vectors")
    # vectors of single precision stay so on their way, which loses nothing
    kind = "float32" if vectors.schema[vec_col].dataType.elementType == T.FloatType() else "float64"
    nodes, members = nodes_of(good, k + 1, kind)
    asked = good.filter(is_query).join(nodes.select("vec", "node"), "vec").select(F.col("id").alias("query_id"), "node")
    asked = materialize(asked, "nn-queries")
    found = search(asked, nodes, build_graph(nodes, kind), kind)

    vecs = nodes.select("node", "vec")
    pairs = found.join(vecs.select(F.col("node").alias("q"), F.col("vec").alias("a")), "q")
    pairs = pairs.join(vecs.select(F.col("node").alias("v"), F.col("vec").alias("b")), "v")
    squares = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.select(F.col("q").alias("node"), "v", F.sqrt(squares).alias("score"))
    # only as many nodes as could fill k places are expanded to their ids
    near = exact.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("score", "v"))).filter(F.col("at") <= k + 1)
    ids = near.join(members.select(F.col("node").alias("v"), F.col("id").alias("vec_id")), "v")
    rows = asked.join(ids, "node").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_query(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("id") % 100 == 0)
