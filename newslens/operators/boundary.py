"""Boundary regions between two classes of vectors: clusters per class, overlapping cluster pairs, cross-class neighbours.

Points are ``(id, side, vector)`` with side 0 or 1; null vectors and vectors with null or non-finite components take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.runtime import materialize

CLUSTERS = 64
SEED_SAMPLE = 2048  # points per side among which the first centres are chosen
SETTLED = 1e-12  # centres that move less are the means of their rows up to rounding
KEPT_SHARE = 0.15
NEIGHBOURS = 10
BLOCK = 512
LEAST_TASKS = 64
STEP, ROUNDING = 2048, 1e-11  # rows measured at a time; bound on the rounding of a product, as a share of the squared lengths


def usable(points: DataFrame) -> DataFrame:
    vector = F.col("vector").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return points.select("id", F.col("side").cast("int").alias("side"), vector.alias("vector")).filter(F.col("vector").isNotNull() & F.col("side").isNotNull() & ~bad)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row, by sums of squared differences; ties to the first.

    Matrix products leave out what is common to all centres of a row; rows with two centres nearest up to their rounding, or with
    numbers too large for them, are measured by differences.
    """
    out = np.empty(len(x), np.int64)
    length = np.einsum("ij,ij->i", centres, centres)
    for i in range(0, len(x), STEP):
        part = x[i : i + STEP]
        with np.errstate(all="ignore"):
            far = length - 2.0 * (part @ centres.T)
            low = far.min(axis=1) + ROUNDING * (np.einsum("ij,ij->i", part, part) + length.max())
            unsure = np.flatnonzero((~(far > low[:, None])).sum(axis=1) != 1)
        near = far.argmin(axis=1)
        for j in range(0, len(unsure), 256):
            rows = unsure[j : j + 256]
            near[rows] = ((part[rows, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        out[i : i + STEP] = near
    return out


def first_centres(points: DataFrame, k: int, sample: int = SEED_SAMPLE) -> dict[int, np.ndarray]:
    """Per side, farthest-first among the ``sample`` points with the smallest md5 of their id."""
    out = {}
    for side in (0, 1):
        drawn = points.filter(F.col("side") == side).select("vector").orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
        x = np.array([r.vector for r in drawn.collect()], np.float64)
        if not len(x):
            continue
        chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < k and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out[side] = x[chosen]
    return out


def assigned(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``(id, side, vector, cluster)``; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side, x = batch.column(1).to_numpy(), _matrix(batch.column(2))
                cluster = np.zeros(len(side), np.int32)
                for s, c in centres.items():
                    cluster[side == s] = _nearest(x[side == s], c)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], names=["id", "side", "vector", "cluster"])

    kind = points.schema["id"].dataType.simpleString()
    return points.mapInArrow(run, f"id {kind}, side int, vector array<double>, cluster int")


def _packed(points: DataFrame) -> DataFrame:
    """``(side, n, block)``: the vectors of a batch and side as the bytes of one matrix, which many passes read without taking lists apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                held = np.unique(side)
                columns = [held.astype(np.int32), [int((side == s).sum()) for s in held], [x[side == s].tobytes() for s in held]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["side", "n", "block"])

    return points.select("side", "vector").mapInArrow(run, "side int, n int, block binary")


def _sums(packed: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``(side, totals, counts)`` of each task: sums and numbers of the rows nearest to each centre, as bytes.

    The number of tasks follows the cores, not the rows, and so does what a pass sends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {s: np.zeros(c.shape) for s, c in centres.items()}
        counts = {s: np.zeros(len(c), np.int64) for s, c in centres.items()}
        for batch in batches:
            for s, n, block in zip(*batch.columns):
                s = s.as_py()
                if s not in centres:
                    continue
                mine = np.frombuffer(block.as_buffer()).reshape(n.as_py(), -1)
                at = _nearest(mine, centres[s])
                held = np.bincount(at, minlength=len(centres[s]))
                first = (np.cumsum(held) - held)[held > 0]
                totals[s][held > 0] += np.add.reduceat(mine[np.argsort(at, kind="stable")], first)
                counts[s] += held
        for s, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([total.tobytes()]), pa.array([counts[s].tobytes()])], names=["side", "totals", "counts"])

    tasks = max(LEAST_TASKS, 4 * packed.sparkSession.sparkContext.defaultParallelism)
    return packed.coalesce(tasks).mapInArrow(run, "side int, totals binary, counts binary")


def class_clusters(points: DataFrame, k: int = CLUSTERS, sample: int = SEED_SAMPLE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``(id, side, vector, cluster)``, stored, and the centres: Lloyd's iterations per side until no centre moves.

    A pass returns ``2 * k`` sums a task to the driver, and the tasks follow the cores, not the rows. A centre without rows stays where it is.
    """
    points = materialize(usable(points), "points")
    centres = first_centres(points, k, sample)
    moved = bool(centres)
    packed = materialize(_packed(points), "packed-points") if moved else None
    while moved:
        new = {s: c.copy() for s, c in centres.items()}
        totals, counts = {s: np.zeros(c.shape) for s, c in centres.items()}, {s: np.zeros(len(c), np.int64) for s, c in centres.items()}
        for r in _sums(packed, centres).collect():
            totals[r.side] += np.frombuffer(r.totals).reshape(totals[r.side].shape)
            counts[r.side] += np.frombuffer(r.counts, np.int64)
        for s, n in counts.items():
            new[s][n > 0] = totals[s][n > 0] / n[n > 0, None]
        moved = any(np.abs(new[s] - c).max() > SETTLED for s, c in centres.items())
        centres = new
    return materialize(assigned(points, centres), "clusters"), centres


def cluster_shapes(points: DataFrame) -> DataFrame:
    """``(side, cluster, n, centre, radius)`` of assigned points; radius is the root mean square distance from the centre."""
    parts = points.select("side", "cluster", F.posexplode("vector").alias("dim", "x"))
    per_dim = parts.groupBy("side", "cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("spread"))
    shape = per_dim.groupBy("side", "cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("c"), F.sum("spread").alias("s"))
    return shape.select("side", "cluster", "n", F.col("c.mean").alias("centre"), F.sqrt("s").alias("radius"))


def cluster_pairs(shapes: DataFrame, share: float = KEPT_SHARE) -> DataFrame:
    """``(p, q, distance, affinity, place, kept)`` of every cluster pair across the sides: k * k rows, for k a parameter.

    Affinity is the sum of the radii over the distance of the centres; kept are pairs among the highest ``share`` of
    affinities (``place`` is their percent rank from the top).
    """
    left, right = (shapes.filter(F.col("side") == s).select(F.col("cluster").alias(c), F.col("centre").alias(f"c{c}"), F.col("radius").alias(f"r{c}")) for s, c in ((0, "p"), (1, "q")))
    gap = F.sqrt(F.aggregate(F.zip_with("cp", "cq", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    pairs = left.join(F.broadcast(right)).select("p", "q", gap.alias("distance"), (F.col("rp") + F.col("rq")).alias("reach"))
    scored = pairs.select("p", "q", "distance", F.when(F.col("distance") > 0, F.col("reach") / F.col("distance")).otherwise(F.lit(float("inf"))).alias("affinity"))
    place = F.percent_rank().over(Window.orderBy(F.desc("affinity"), "p", "q"))
    return scored.withColumn("place", place).withColumn("kept", F.col("place") <= share)


def boundary_pairs(points: DataFrame, pairs: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """``(p, q, id, rank, neighbour, distance)``: of each point of cluster p its k nearest of cluster q, for kept pairs ``(p, q)``.

    Both clusters are cut into blocks of about ``block`` points by a hash of the id, and each pair of blocks is joined
    by its own key, so a cluster of any size is spread over all tasks. A pair of blocks returns k rows a point.
    Ties go to the smaller id.
    """
    kind = points.schema["id"].dataType.simpleString()
    sizes = points.groupBy("side", "cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    slot = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")

    def blocks(side: int, cluster: str, own: str) -> DataFrame:
        mine = points.filter(F.col("side") == side).select("id", "vector", "cluster").join(F.broadcast(sizes.filter(F.col("side") == side).drop("side")), "cluster")
        return mine.groupBy(F.col("cluster").alias(cluster), slot.alias(own)).agg(F.collect_list(F.struct("id", "vector")).alias(f"{own}s"))

    def counted(side: int, cluster: str, name: str) -> DataFrame:
        return sizes.filter(F.col("side") == side).select(F.col("cluster").alias(cluster), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(name))

    keys = pairs.select("p", "q").join(F.broadcast(counted(0, "p", "left")), "p").join(F.broadcast(counted(1, "q", "right")), "q")
    met = keys.join(blocks(0, "p", "left"), ["p", "left"]).join(blocks(1, "q", "right"), ["q", "right"]).select("p", "q", "lefts", "rights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, x), (b, y) = ((s.field("id"), _matrix(s.field("vector"))) for s in (batch.column(c)[i].values for c in (2, 3)))
                order = np.argsort(b.to_numpy(zero_copy_only=False), kind="stable")
                b, y = b.take(pa.array(order)), y[order]
                many = min(k, len(y))
                for begin in range(0, len(x), 32):
                    part = x[begin : begin + 32]
                    far = np.sqrt(((part[:, None, :] - y[None]) ** 2).sum(axis=2))
                    near = np.argsort(far, axis=1, kind="stable")[:, :many]
                    row = np.repeat(np.arange(len(part)), many)
                    columns = [pa.array(np.full(len(row), batch.column(c)[i].as_py(), np.int32)) for c in (0, 1)]
                    columns += [a.take(pa.array(row + begin)), b.take(pa.array(near.ravel())), pa.array(far[row, near.ravel()])]
                    yield pa.RecordBatch.from_arrays(columns, names=["p", "q", "id", "neighbour", "distance"])

    found = met.mapInArrow(run, f"p int, q int, id {kind}, neighbour {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("p", "q", "id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("p", "q", "id", "rank", "neighbour", "distance")
