"""How well a second space keeps the structure of a first one: rank correlation of distances, shared nearest neighbours.

Queries are a stated set of rows, measured against all rows in blocks. The exact ranks of many distances need all of them in
one order; beyond ``EXACT_PAIRS`` the distances are measured twice instead and none is stored: the first pass counts them in
bins of a relative width of 2^-16, the second gives each the middle rank of its bin. Rows are ``(id, query, a, b)``: a boolean that marks
queries, and a vector in each space; the spaces may differ in length. Rows with a null id or vector, or with a null or non-finite
component, take no part; ids must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.operators.ordering import attach, running_total
from newslens.runtime import materialize

QUERY_BLOCK, BLOCK, STEP = 256, 2048, 32
NEIGHBOURS = 10
# Many distances: rows of a pair of blocks, and distances up to which all are stored and ranked one by one.
MANY_QUERIES, MANY_ROWS, EXACT_PAIRS = 2048, 4096, 10_000_000
# Ranks by bins: the trailing bits of a double that are dropped, the widest table of bins, and the largest share of pairs in a bin of
# unequal values. Ranks inside a bin become their mean, so a correlation moves by about the square of that share.
DROPPED, MAX_BINS, MAX_SHARE = 36, 1 << 23, 2.0**-12
STEP_ROWS, TALLY = 2048, 1 << 22  # rows measured at a time, distances held before they are counted


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _usable(rows: DataFrame) -> DataFrame:
    columns = [F.col(c).cast("array<double>").alias(c) for c in ("a", "b")]
    fine = F.col("id").isNotNull()
    for c in ("a", "b"):
        fine = fine & F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select("id", F.coalesce("query", F.lit(False)).alias("query"), *columns).filter(fine)


def _blocks(usable: DataFrame, n: int, n_queries: int, query_block: int, block: int) -> DataFrame:
    """``(left, right, asks, id, a, b)``: every block of queries next to every block of rows."""
    rights, lefts = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    place = F.xxhash64("id")
    numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    asked = usable.filter("query").select(F.pmod(place, F.lit(lefts)).alias("left"), numbers(rights).alias("right"), F.lit(True).alias("asks"), "id", "a", "b")
    others = usable.select(numbers(lefts).alias("left"), F.pmod(place, F.lit(rights)).alias("right"), F.lit(False).alias("asks"), "id", "a", "b")
    return asked.unionByName(others)


def query_distances(rows: DataFrame, k: int = NEIGHBOURS, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """``(query, id, x, y, near_a, near_b)``, stored: Euclidean distances of each query to every other row in both spaces.

    ``near_a`` and ``near_b`` mark the k nearest of the query inside a block, ties to the smaller id, so neighbours are
    found later from k rows per block instead of all. A task holds one block of each side; both are spread by hash of the id
    before the shuffle, so no key holds more than two blocks.
    """
    usable = materialize(_usable(rows), "structure-rows")
    blocks = _blocks(usable, *usable.agg(F.count(F.lit(1)), F.count_if("query")).first(), query_block, block)
    kind = usable.schema["id"].dataType.simpleString()
    names = ["query", "id", "x", "y", "near_a", "near_b"]

    def far(group: pa.Table, asks: np.ndarray, c: str) -> np.ndarray:
        v = _matrix(group.column(c).combine_chunks())
        q, r = v[asks], v[~asks]
        out = np.empty((len(q), len(r)))
        for i in range(0, len(q), STEP):
            out[i : i + STEP] = np.sqrt(((q[i : i + STEP, None, :] - r[None]) ** 2).sum(axis=2))
        return out

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        group = group.take(pa.array(np.lexsort((group.column("id").to_numpy(), ~asks))))
        asks = np.sort(asks)[::-1]
        if asks.all() or not asks.any():
            return pa.table([pa.array([], t) for t in (group.schema.field("id").type,) * 2 + (pa.float64(),) * 2 + (pa.bool_(),) * 2], names=names)
        ids = group.column("id").combine_chunks()
        queries, others = ids.filter(pa.array(asks)), ids.filter(pa.array(~asks))
        q, o = queries.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)
        self_pair = q[:, None] == o[None]
        columns, nears = [], []
        for c in ("a", "b"):
            d = far(group, asks, c)
            d[self_pair] = np.inf
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :k], True, axis=1)
            columns.append(d[~self_pair])
            nears.append(near[~self_pair])
        i, j = np.nonzero(~self_pair)
        return pa.table([queries.take(pa.array(i)), others.take(pa.array(j)), *map(pa.array, columns), *map(pa.array, nears)], names=names)

    pairs = blocks.groupBy("left", "right").applyInArrow(run, f"query {kind}, id {kind}, x double, y double, near_a boolean, near_b boolean")
    return materialize(pairs, "query-distances")


def _ranked(counts: DataFrame, value: str, total: int) -> DataFrame:
    """``(x, y, n, ...)`` with the mid-rank of ``value`` among all pairs as ``<value>_rank``.

    Pairs of equal value are one row before anything is ordered; ranks are running counts over value ranges. A value that
    many pairs share (distance 0 of copies) is joined back as a hot key.
    """
    per_value = materialize(counts.groupBy(value).agg(F.sum("n").alias("_of"), F.count(F.lit(1)).alias("_rows")), "values")
    ranks = running_total(per_value, value, "_of", "_below").select(value, "_rows", (F.col("_below") + (F.col("_of") + 1) / 2.0).alias(f"{value}_rank"))
    return attach(counts, ranks, value, [f"{value}_rank"], "_rows", total, ["x", "y"])


def rank_correlation(pairs: DataFrame) -> DataFrame:
    """``(pairs, spearman)``: Spearman's correlation of ``x`` and ``y`` with mid-ranks; null where a side is constant."""
    counts = materialize(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "distinct-pairs")
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ranked = _ranked(_ranked(counts, "x", different), "y", different)
    middle = (total + 1) / 2.0
    x, y, n = F.col("x_rank") - middle, F.col("y_rank") - middle, F.col("n")
    sums = ranked.agg(F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    return sums.select(F.lit(total).cast("bigint").alias("pairs"), (F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("spearman"))


def neighbour_overlap(pairs: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``(query, n, overlap)``: how many of a query's k nearest in the first space are among its k nearest in the second,
    out of ``n``, which is k unless the query has fewer other rows."""

    def nearest(near: str, distance: str) -> DataFrame:
        order = Window.partitionBy("query").orderBy(distance, "id")
        return pairs.filter(near).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "id")

    both = nearest("near_a", "x").withColumn("first", F.lit(1)).join(nearest("near_b", "y").withColumn("second", F.lit(1)), ["query", "id"], "full")
    return both.groupBy("query").agg(F.count("first").alias("n"), F.count_if(F.col("first").isNotNull() & F.col("second").isNotNull()).alias("overlap"))


def _measured(group: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Per query of a pair of blocks: its id, the ids of the others in order, which of them are not itself, and both distances."""
    asks = group.column("asks").to_numpy()
    group = group.take(pa.array(np.lexsort((group.column("id").to_numpy(), ~asks))))
    many = int(np.count_nonzero(asks))
    ids = group.column("id").combine_chunks()
    others, plain = ids[many:], ids[many:].to_numpy(zero_copy_only=False)
    spaces = [_matrix(group.column(c).combine_chunks()) for c in ("a", "b")]
    for i in range(many if len(others) else 0):
        x, y = (np.concatenate([np.sqrt(((v[j : j + STEP_ROWS] - v[i]) ** 2).sum(axis=1)) for j in range(many, len(v), STEP_ROWS)]) for v in spaces)
        yield ids[i : i + 1], others, plain != ids[i].as_py(), x, y


def _bins(distances: np.ndarray) -> np.ndarray:
    return distances.view(np.int64) >> DROPPED


def _nearest(distances: np.ndarray, k: int) -> np.ndarray:
    """Marks the k smallest, ties to the first."""
    near = np.zeros(len(distances), bool)
    if len(distances) <= k:
        return ~near
    last = np.partition(distances, k - 1)[k - 1]
    near[distances < last] = True
    near[np.flatnonzero(distances == last)[: k - np.count_nonzero(near)]] = True
    return near


def _tally(bins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    together = np.concatenate(bins)
    least = together.min() if len(together) else 0
    if len(together) and together.max() - least < MAX_BINS:
        counts = np.bincount(together - least)
        held = np.flatnonzero(counts)
        return held + least, counts[held]
    return np.unique(together, return_counts=True)


def _binned(blocks: DataFrame, kind: str, k: int) -> DataFrame:
    """Stored: rows ``(side, bin, n)`` of the distances in both spaces, and rows ``(query, id, x, y, near_a, near_b)`` of the k
    nearest of a query in a block."""
    names = ["side", "bin", "n", "query", "id", "x", "y", "near_a", "near_b"]

    def run(group: pa.Table) -> pa.Table:
        id_type = group.schema.field("id").type
        types = [pa.string(), pa.int64(), pa.int64(), id_type, id_type, pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
        schema = pa.schema(list(zip(names, types)))
        tables, counted, held, pending = [], {"x": {}, "y": {}}, 0, {"x": [], "y": []}

        def flush() -> None:
            for side, bins in pending.items():
                if bins:
                    for b, n in zip(*(v.tolist() for v in _tally(bins))):
                        counted[side][b] = counted[side].get(b, 0) + n
                    bins.clear()

        for query, others, apart, x, y in _measured(group):
            others, x, y = others.filter(pa.array(apart)), x[apart], y[apart]
            pending["x"].append(_bins(x))
            pending["y"].append(_bins(y))
            held += len(x)
            if held > TALLY:
                flush()
                held = 0
            near_a, near_b = _nearest(x, k), _nearest(y, k)
            at = np.flatnonzero(near_a | near_b)
            none = [pa.nulls(len(at), t) for t in types[:3]]
            found = [query.take(pa.array(np.zeros(len(at), np.int64))), others.take(pa.array(at)), x[at], y[at], near_a[at], near_b[at]]
            tables.append(pa.table([*none, *[c if isinstance(c, pa.Array) else pa.array(c) for c in found]], schema=schema))
        flush()
        for side, bins in counted.items():
            values = [pa.array([side] * len(bins)), pa.array(list(bins), pa.int64()), pa.array(list(bins.values()), pa.int64())]
            tables.append(pa.table([*[v.cast(t) for v, t in zip(values, types)], *[pa.nulls(len(bins), t) for t in types[3:]]], schema=schema))
        return pa.concat_tables(tables)

    shape = f"side string, bin bigint, n bigint, query {kind}, id {kind}, x double, y double, near_a boolean, near_b boolean"
    return materialize(blocks.groupBy("left", "right").applyInArrow(run, shape), "binned-distances")


def _rank_tables(counts: DataFrame, total: int) -> dict[str, tuple[int, np.ndarray]] | None:
    """Per side the first bin and the middle rank of every bin from there on, as a share of all pairs less one half; bin 0,
    distance 0, stands in front. None if a bin is too full of unequal values or the bins do not fit a table."""
    fine = F.max(F.when(F.col("bin") > 0, F.col("n"))) <= MAX_SHARE * total
    width = F.max("bin") - F.min(F.when(F.col("bin") > 0, F.col("bin")))
    checks = counts.groupBy("side").agg(F.coalesce(fine & (width < MAX_BINS), F.lit(True)).alias("fine")).collect()
    if not all(r.fine for r in checks):
        return None
    held = counts.toArrow()
    tables = {}
    for side in ("x", "y"):
        mine = held.filter(pa.compute.equal(held["side"], side)).sort_by("bin")
        bins, n = mine["bin"].to_numpy(), mine["n"].to_numpy()
        first = int(bins[bins > 0][0]) if (bins > 0).any() else 1
        table = np.zeros(int(max(bins[-1] - first + 1, 0)) + 1)
        table[np.maximum(bins - first + 1, 0)] = (np.cumsum(n) - n / 2.0) / total - 0.5
        tables[side] = first, table
    return tables


def _binned_correlation(blocks: DataFrame, counts: DataFrame, total: int) -> DataFrame | None:
    """``(pairs, spearman)`` of ranks by bins, or None if the bins are too coarse for these distances."""
    tables = _rank_tables(counts, total)
    if tables is None:
        return None

    def run(group: pa.Table) -> pa.Table:
        sums = np.zeros(3)
        for _, _, apart, *distances in _measured(group):
            p, q = (table[np.maximum(_bins(d[apart]) - first + 1, 0)] for d, (first, table) in zip(distances, tables.values()))
            sums += [p @ q, p @ p, q @ q]
        return pa.table([pa.array([s]) for s in sums], names=["xy", "xx", "yy"])

    sums = blocks.groupBy("left", "right").applyInArrow(run, "xy double, xx double, yy double").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    return sums.select(F.lit(total).cast("bigint").alias("pairs"), (F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("spearman"))


def structure_kept(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``(pairs, spearman, queries, preservation)`` in one row: rank correlation of all measured distances, and the mean share
    of nearest neighbours that both spaces have in common (null without queries that have another row)."""
    usable = materialize(_usable(rows), "structure-rows")
    n, n_queries = usable.agg(F.count(F.lit(1)), F.count_if("query")).first()
    correlation = None
    if n * n_queries > EXACT_PAIRS:
        blocks = _blocks(usable, n, n_queries, MANY_QUERIES, MANY_ROWS)
        pairs = _binned(blocks, usable.schema["id"].dataType.simpleString(), k)
        counts = materialize(pairs.filter("side is not null").groupBy("side", "bin").agg(F.sum("n").alias("n")), "distance-bins")
        total = counts.filter("side = 'x'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        correlation = _binned_correlation(blocks, counts, total) if total else None
    if correlation is None:
        pairs = query_distances(usable, k)
        correlation = rank_correlation(pairs)
    share = neighbour_overlap(pairs.filter("query is not null"), k).agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("overlap") / F.col("n")).alias("preservation"))
    return correlation.join(share)
