"""Near-duplicate groups: SimHash, block keys, verified pairs, connected components.

Identical signatures are collapsed before anything is joined, so a text copied
a billion times is one node. Pairs are found by the pigeonhole rule: two 64-bit
signatures that differ in at most t bits agree on at least m - t of m blocks,
for every m > t (Manku, Jain and Das Sarma, 2007). Longer keys cost more copies
per signature but make buckets smaller; only signatures that sit in an
overfull bucket are re-keyed with longer keys, until a bucket cannot be large.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.hashing import simhash64
from newslens.functions.scalars import hamming
from newslens.operators.ordering import attach
from newslens.runtime import by_shuffle, materialize, spread

BITS = 64
# The band layout of the method, 8 bands of 8 bits.
BANDS, BAND_BITS = 8, 8
MAX_BUCKET = 4096
MAX_COPIES = 600
# Comparison of all signatures: blocks of 8,192 up to 64 of them, then fuller ones, then more; distances held at a time.
SIG_BLOCK, FULL_BLOCKS, LARGEST_BLOCK, STRIP = 8192, 64, 65_536, 1 << 18


def signatures(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``(id, sig)`` per row; narrow."""
    rows = spread(docs.select(id_col, text), id_col)
    return rows.select(F.col(id_col).alias("id"), simhash64(text).alias("sig"))


def distinct_signatures(sigs: DataFrame) -> DataFrame:
    """One node per signature: ``(sig, rep, n)`` with the smallest id and the copy count."""
    return sigs.groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))


def band_value(sig: Column, band: Column) -> Column:
    return F.call_function("shiftrightunsigned", sig, band * F.lit(BAND_BITS)).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def band_profile(sigs: DataFrame) -> DataFrame:
    """Load of the plain 8x8 banding over all rows: buckets, candidate pairs, largest bucket per band.

    The pair number comes from the bucket sizes; no pair is built.
    """
    bands = (
        sigs.groupBy("sig")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
        .withColumn("value", band_value(F.col("sig"), F.col("band")))
    )
    sizes = bands.groupBy("band", "value").agg(F.sum("n").alias("n"))
    return sizes.groupBy("band").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.sum(F.expr("n * (n - 1) div 2")).alias("candidate_pairs"),
        F.max("n").alias("largest_bucket"),
    )


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def key_levels(nodes: int, max_bits: int) -> list[int]:
    """Block counts to try, shortest keys first.

    The first level gives about 64 signatures per key if they were spread
    evenly. For ``max_bits <= 3`` the last level has at most 4,096 possible
    signatures per key, so its buckets are bounded whatever the data.
    """
    usable = [m for m in range(max_bits + 1, BITS // 2) if comb(m, max_bits) <= MAX_COPIES] or [max_bits + 1]
    first = next((m for m in usable if nodes / 2 ** (BITS * (m - max_bits) / m) <= BITS), usable[-1])
    middle = [m for m in usable if m > first][: -1 : 4]
    return list(dict.fromkeys([first, *middle, usable[-1]]))


def _keyed(nodes: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """One row per signature and choice of ``blocks - max_bits`` clean blocks."""
    masks = _block_masks(blocks)
    choices = list(combinations(range(blocks), blocks - max_bits))
    bit_masks = F.array(*[F.lit(_signed(sum(masks[b] for b in c))) for c in choices])
    return nodes.select("sig", F.posexplode(bit_masks).alias("choice", "mask")).select(
        "sig", "choice", F.col("sig").bitwiseAND(F.col("mask")).alias("key")
    )


def _first_shared_choice(diff: Column, blocks: int, max_bits: int) -> Column:
    """True for exactly one of the keys two signatures share: their first clean blocks."""
    masks = _block_masks(blocks)
    clean = [F.when(diff.bitwiseAND(F.lit(_signed(m))) == 0, 1 << i).otherwise(0) for i, m in enumerate(masks)]
    clean_bits = reduce(lambda a, b: a + b, clean)
    wanted, upto = [], []
    for choice in combinations(range(blocks), blocks - max_bits):
        wanted.append(F.lit(sum(1 << b for b in choice)))
        upto.append(F.lit((1 << (choice[-1] + 1)) - 1))
    at = F.col("a.choice") + 1
    return clean_bits.bitwiseAND(F.element_at(F.array(*upto), at)) == F.element_at(F.array(*wanted), at)


def _verified(keyed: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """Join inside buckets; the distance test is part of the join, so only true pairs leave it."""
    a, b = keyed.alias("a"), keyed.alias("b")
    diff = F.col("a.sig").bitwiseXOR(F.col("b.sig"))
    found = a.join(
        by_shuffle(b),
        (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.sig") < F.col("b.sig"))
        & (F.bit_count(diff) <= max_bits),
    )
    return found.filter(_first_shared_choice(diff, blocks, max_bits)).select(
        F.col("a.sig").alias("sig_a"), F.col("b.sig").alias("sig_b"), F.bit_count(diff).alias("distance")
    )


def _banded_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Distances of 8 bits and more: the method itself only sees pairs with an equal band, and so do we.

    At such distances the equal band prunes little and the pairs themselves grow with the square of the signatures, so all
    signatures are compared, a pair of hash blocks at a time. A task holds two blocks and at most ``STRIP`` distances.
    """
    known = nodes.filter("sig is not null")
    n = known.count()
    count = max(1, -(-n // min(max(n // FULL_BLOCKS, SIG_BLOCK), LARGEST_BLOCK)))
    blocks = known.groupBy(F.pmod(F.xxhash64("sig"), F.lit(count)).alias("j")).agg(F.collect_list("sig").alias("right"))
    first = blocks.select(F.col("j").alias("i"), F.col("right").alias("left"), F.explode(F.sequence("j", F.lit(count - 1).cast("bigint"))).alias("j"))
    return first.join(blocks, "j").repartition(count * (count + 1) // 2, "i", "j").select("i", "j", "left", "right").mapInArrow(
        lambda batches: _compared(batches, max_bits), "sig_a bigint, sig_b bigint, distance int"
    )


def _compared(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks, or inside one block, that are near and have an equal band."""
    for batch in batches:
        for i, j, left, right in zip(*batch.columns):
            left, right = (side.values.to_numpy() for side in (left, right))
            step = max(1, STRIP // len(right))
            for at in range(0, len(left), step):
                strip = left[at : at + step]
                diff = strip[:, None] ^ right[None]
                distance = np.bitwise_count(diff.view(np.uint64))
                p, q = np.nonzero(distance <= max_bits)
                found = diff[p, q]
                banded = reduce(np.logical_or, [found & _signed(0xFF << (BAND_BITS * b)) == 0 for b in range(BANDS)])
                if i == j:
                    banded &= strip[p] < right[q]
                p, q = p[banded], q[banded]
                a, b = strip[p], right[q]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(distance[p, q].astype(np.int32))], names=["sig_a", "sig_b", "distance"]
                )


def near_pairs(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(sig_a, sig_b, distance)`` with sig_a < sig_b and distance <= ``max_bits``, each pair once."""
    if max_bits >= BANDS:
        return _banded_pairs(nodes, max_bits)
    if max_bits <= 0:
        return nodes.select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"), F.lit(0).alias("distance")).limit(0)
    levels = key_levels(nodes.count(), max_bits)
    active, parts = nodes.select("sig"), []
    for blocks in levels:
        keyed = _keyed(active, blocks, max_bits)
        if blocks == levels[-1]:
            parts.append(_verified(keyed, blocks, max_bits))
            break
        sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.agg(F.max("size")).first()[0] or 0
        if largest <= MAX_BUCKET:
            parts.append(_verified(keyed, blocks, max_bits))
            break
        # overfull buckets: their members, and only they, go on to longer keys
        bucket = F.struct("choice", "key")
        sized = materialize(
            attach(
                keyed.withColumn("bucket", bucket),
                sizes.withColumn("bucket", bucket).select("bucket", "size"),
                "bucket",
                ["size"],
                "size",
                keyed.count(),
                ["sig"],
            ),
            "sized-keys",
        )
        parts.append(_verified(sized.filter(F.col("size") <= MAX_BUCKET).select("sig", "choice", "key"), blocks, max_bits))
        active = materialize(sized.filter(F.col("size") > MAX_BUCKET).select("sig").distinct(), "overfull")
    pairs = reduce(DataFrame.unionByName, parts)
    return pairs if len(parts) == 1 else pairs.distinct()


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("deg"))


def _large_star(edges: DataFrame, edge_count: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _neighbour_minimum(both).withColumn("low", F.least("low", "u"))
    linked = attach(both.filter("v > u"), low, "u", ["low"], "deg", 2 * edge_count, ["v"])
    return linked.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame, edge_count: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _neighbour_minimum(down)
    linked = attach(down, low, "u", ["low"], "deg", edge_count, ["v"])
    return (
        linked.select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionByName(low.select("u", F.col("low").alias("v")))
        .filter("u > v")
        .distinct()
    )


def _edge_state(edges: DataFrame) -> tuple[int, bool]:
    """Edge count, and whether the edges already form stars (one parent each, no parent has a parent)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    count, loose = per_node.agg(
        F.sum("up"), F.sum(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1).otherwise(0))
    ).first()
    return count or 0, not loose


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge table ``(u, v)``; root is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    every component is a star. Every round is written to shared storage, so
    the plan stays short and a lost executor costs one round at most.
    """
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialize(down.distinct(), "edges")
    count, done = _edge_state(current)
    while not done:
        current = materialize(_small_star(_large_star(current, count), count), "stars")
        count, done = _edge_state(current)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicate_groups(docs: DataFrame, id_col: str, text: str = "text", max_bits: int = 3) -> DataFrame:
    """``(id, group_id)`` for every row; group_id is the smallest id of the group, singletons included."""
    sigs = materialize(signatures(docs, id_col, text), "signatures")
    nodes = materialize(distinct_signatures(sigs), "nodes")
    pairs = near_pairs(nodes, max_bits)
    roots = connected_components(pairs.select(F.col("sig_a").alias("u"), F.col("sig_b").alias("v")))
    linked = nodes.join(by_shuffle(roots), nodes.sig == roots.node, "left").select(
        "sig", "rep", "n", F.coalesce("root", "sig").alias("root")
    )
    group_ids = linked.groupBy("root").agg(F.min("rep").alias("group_id"), F.count(F.lit(1)).alias("deg"))
    rows, signature_count = nodes.agg(F.sum("n"), F.count(F.lit(1))).first()
    labelled = attach(linked, group_ids, "root", ["group_id"], "deg", signature_count, ["sig"])
    by_signature = materialize(labelled.select("sig", "n", "group_id"), "groups")
    return attach(sigs, by_signature, "sig", ["group_id"], "n", rows or 0, ["id"]).select("id", "group_id")
