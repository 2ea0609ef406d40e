"""How five filters interact: what each removes, and what it would remove anyway, in every order.

Removal ranks by a min-plus product. A document's failures are a mask; with ``M[mask, f]`` 0 where the mask fails
filter ``f`` and infinite elsewhere, and ``P[order, f]`` the position of ``f`` in an order (its inverse
permutation), ``min over f of M[mask, f] + P[order, f]`` is the step that removes the documents of that mask. Spark
reduces the documents to counts per part and mask, at most 32 rows a part; the ranks then scatter those
counts to steps, and failures behind the rank are redundant.

Documents with equal text are told by sha256. Per document only its id, digest, part and mask are shuffled; copies are
collapsed per (digest, part) before the smallest id of a digest is sought, so a text of a third of all rows is one row a task.

Defined results: a null text is an empty one (no words: it fails A, and E when a smaller id has no text either); a null
``lang`` is the part ``''``. Rows without an id are never a duplicate of a smaller id, nor is any other row because of
them. Repeated rows count as often as they occur and are no duplicates of each other, as their ids are equal. A document
is good or toxic if any of its label rows says so. An empty table has no parts and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
KEPT = len(FILTERS)  # the rank of documents that no filter removes


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (null: empty) fails; E needs the other documents."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    tests = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per part and set of failed filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        failures(text).alias("mask"),
    )
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    one = F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    same = rows.join(marks, "id", "left").select("id", "part", "digest", "mask", *one)
    same = same.groupBy("id", "digest", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    size = F.struct("n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    per_text = same.select("*", size.alias("size")).groupBy("digest", "part", "mask").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "size"))).alias("first"),
        *[F.sum(f"size.{c}").alias(c) for c in ("n", "good", "toxic")],
        *[F.sum(F.when(F.col("id").isNull(), F.col(f"size.{c}")).otherwise(0)).alias(f"no_id_{c}") for c in ("n", "good", "toxic")],
    )
    holds_first = F.coalesce(F.col("first.id") == F.min("first.id").over(Window.partitionBy("digest")), F.lit(False))
    told = per_text.withColumn("holds_first", holds_first)
    firsts = {c: F.col(f"no_id_{c}") + F.when(F.col("holds_first"), F.col(f"first.size.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    alone = F.struct(F.col("mask"), *[v.alias(c) for c, v in firsts.items()])
    again = F.struct((F.col("mask") + (1 << 4)).alias("mask"), *[(F.col(c) - v).alias(c) for c, v in firsts.items()])
    both = told.select("part", F.explode(F.array(alone, again)).alias("x")).select("part", "x.*").filter("n > 0")
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def removal_ranks() -> np.ndarray:
    """``(orders, masks)``: the step, from 0, at which an order removes a mask; ``KEPT`` for the empty mask."""
    far = np.int64(1) << 30
    fails = (np.arange(MASKS)[:, None] >> np.arange(KEPT)) & 1
    masks = np.where(fails == 1, 0, far)
    inverse = np.argsort([[FILTERS.index(f) for f in order] for order in ORDERS], axis=1)
    return np.minimum((masks[None] + inverse[:, None]).min(axis=2), KEPT)


def audit_part(counts: np.ndarray) -> dict[str, np.ndarray]:
    """From ``counts[measure, mask]`` (all, good, toxic) the measures per order and step, each ``(orders, steps)``."""
    ranks = removal_ranks()
    fails = ((np.arange(MASKS)[:, None] >> np.arange(KEPT)) & 1).astype(bool)
    order_of = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    n = len(ORDERS)
    slot = (np.arange(n)[:, None] * (KEPT + 1) + ranks).ravel()
    gone, good, toxic = (np.zeros(n * (KEPT + 1), np.int64) for _ in range(3))
    for into, weights in zip((gone, good, toxic), counts):
        np.add.at(into, slot, np.tile(weights, n))
    gone, good, toxic = (x.reshape(n, KEPT + 1)[:, :KEPT] for x in (gone, good, toxic))
    late = ranks[:, None, :] < np.arange(KEPT)[None, :, None]  # removed before this step
    failing = fails.T[order_of]  # of the filter at this step, per mask
    shapley = np.zeros(KEPT, np.int64)
    np.add.at(shapley, order_of, gone)
    return {
        "kept": counts[0].sum() - gone.cumsum(axis=1),
        "removed": gone,
        "redundant": (late & failing) @ counts[0],
        "unique_fails": counts[0][1 << order_of],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": shapley[order_of],
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [o for o in ORDERS for _ in o]
        steps, filters = np.tile(np.arange(1, KEPT + 1, dtype=np.int32), len(ORDERS)), list("".join(ORDERS))
        for batch in batches:
            for part, cells in zip(batch.column(0), batch.column(1)):
                counts = np.zeros((3, MASKS), np.int64)
                for cell in cells.as_py():
                    counts[:, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                out = audit_part(counts)
                columns = [pa.array([part.as_py()] * len(names)), pa.array(names), pa.array(steps), pa.array(filters)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out[m].ravel()) for m in measures], names=["part", "filter_order", "step", "filter", *measures])

    cells = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{m} bigint" for m in measures))


def op12_query(spark: SparkSession, sf: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


ORACLE = r"""
WITH marks AS (
  SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text,
         regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words,
         MIN(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS first_id
  FROM documents
), fails AS (
  SELECT t.part, COALESCE(m.good, 0) AS good, COALESCE(m.toxic, 0) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    COALESCE(t.doc_id > t.first_id, FALSE)] AS f
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id
), masks AS (
  SELECT part, f, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM fails GROUP BY part, f
), letters AS (
  SELECT unnest(range(1, 6)) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k
), steps AS (
  SELECT o, s.k AS step, o[s.k] AS flt FROM orders, letters s
), cells AS (
  SELECT m.part, o, step, flt, n, good, toxic, f[flt] AS failing,
         list_contains(list_transform(o[1:step - 1], lambda x: f[x]), TRUE) AS gone,
         f[flt] AND NOT list_contains(list_transform(list_filter(o, lambda x: x <> flt), lambda x: f[x]), TRUE) AS only_here
  FROM masks m, steps
), per_step AS (
  SELECT part, o, step, flt,
         SUM(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
         SUM(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
         SUM(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
         SUM(CASE WHEN only_here THEN n ELSE 0 END) AS unique_fails,
         SUM(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost,
         SUM(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells GROUP BY part, o, step, flt
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order,
       CAST(step AS INTEGER) AS step, substr('ABCDE', flt, 1) AS filter,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(SUM(removed) OVER (PARTITION BY part, flt) AS BIGINT) AS shapley
FROM per_step
"""
