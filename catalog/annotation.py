"""Queries of the annotation loop over ``embeddings``, ``documents`` and ``labels``, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.common import table
from newslens.operators import agreement as ag
from newslens.operators import boundary as bd
from newslens.operators import coverage as cv
from newslens.operators import structure as st

ROUNDS = 6


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("side"), F.col("embedding").alias("vector"), "label")


def _by_label(spark: SparkSession, sf: str) -> DataFrame:
    """The labels 0 to 9 as clusters, five a side."""
    points = _points(spark, sf)
    return bd.usable(points).join(points.select("id", F.col("label").cast("int").alias("cluster")), "id")


def x1_class_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Per side: rows, and how many of them are nearer to another centre, and centres that are not the mean of their rows."""
    rows, centres = bd.class_clusters(_points(spark, sf))
    shapes = bd.cluster_shapes(rows)
    flat = spark.createDataFrame([(s, k, c.tolist()) for s, cs in centres.items() for k, c in enumerate(cs)], "side int, cluster int, centre array<double>")
    gap = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, u: t + u)
    off = shapes.join(flat.withColumnRenamed("centre", "found"), ["side", "cluster"]).groupBy("side").agg(F.sum((gap("centre", "found") > 1e-18).cast("bigint")).alias("n_off"))
    per_side = flat.groupBy("side").agg(F.collect_list(F.struct("cluster", "centre")).alias("centres"))
    nearest = F.array_min(F.transform("centres", lambda c: F.struct(gap(F.col("vector"), c["centre"]).alias("d"), c["cluster"].alias("other"))))
    each = rows.join(F.broadcast(per_side), "side").select("side", "id", "cluster", nearest.alias("best")).groupBy("side", "id", "cluster").agg(F.min("best")["other"].alias("best"))
    placed = each.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("best") != F.col("cluster")).cast("bigint")).alias("n_misplaced"), (F.countDistinct("cluster") > 1).alias("several"))
    return placed.join(off, "side")


def x2_cluster_affinity(spark: SparkSession, sf: str) -> DataFrame:
    pairs = bd.cluster_pairs(bd.cluster_shapes(_by_label(spark, sf)))
    return pairs.select("p", "q", *[F.round(c, 6).alias(c) for c in ("distance", "affinity", "place")], "kept")


def x3_boundary_pairs(spark: SparkSession, sf: str) -> DataFrame:
    points = _by_label(spark, sf)
    kept = bd.cluster_pairs(bd.cluster_shapes(points)).filter("kept")
    return bd.boundary_pairs(points, kept).select("p", "q", "id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    """Two raters of a document: the quality label, and the rule that a good text has at least 400 characters."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), (F.col("n_chars") >= 400).cast("int").alias("rule"))
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")


def x5_kappa_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    out = ag.kappa_bootstrap(_rated(spark, sf), "doc_id", "quality", "rule", "lang")
    return out.select("part", "n", *[F.round(c, 8).alias(c) for c in ("observed", "expected", "kappa", "low", "high")], "passes")


def x6_plateau(spark: SparkSession, sf: str) -> DataFrame:
    items = ag.annotation_rounds(_rated(spark, sf), "doc_id", ROUNDS).filter("held_out")
    per_round = ag.kappas(ag.counted_pairs(items, "doc_id", "quality", "rule", "round", 1)).filter("replicate = -1")
    out = ag.plateau(per_round.select(F.col("part").alias("round"), "kappa"), ceiling=ag.GATE)
    return out.select("round", F.round("kappa", 8).alias("kappa"), F.round("gain", 8).alias("gain"), "flat", "stop")


def x4_greedy_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents near the rule's limit of 400 characters, dense in (lang, source), spread over language, source and length."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.floor(F.col("n_chars") / 100).alias("hundreds"), (F.col("n_chars") / (F.col("n_chars") + 400.0)).alias("p"))
    dense = cv.cell_density(docs, ["lang", "source"])
    out = cv.greedy_coverage(dense.withColumn("priority", cv.uncertainty(F.col("p")) * F.col("density")), "doc_id", "priority", ["lang", "source", "hundreds"])
    return out.select("step", F.col("id").alias("doc_id"), F.round("gain", 10).alias("gain"))


def x7_structure(spark: SparkSession, sf: str) -> DataFrame:
    """What the first 16 coordinates keep of the distances and neighbours of whole vectors; queries are ids divisible by 100."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100 == 0).alias("query"), F.col("embedding").alias("a"), F.slice("embedding", 1, 16).alias("b"))
    return st.structure_kept(rows).select("pairs", F.round("spearman", 6).alias("spearman"), "queries", F.round("preservation", 8).alias("preservation"))


QUERIES = {f.__name__: f for f in (x1_class_clusters, x2_cluster_affinity, x3_boundary_pairs, x4_greedy_coverage, x5_kappa_bootstrap, x6_plateau, x7_structure)}

_AFFINITY = f"""v AS (SELECT vec_id AS id, CAST(label AS INT) AS cluster, label >= 5 AS side, embedding::DOUBLE[] AS e FROM embeddings),
  x AS (SELECT cluster, side, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS dim FROM v),
  d AS (SELECT cluster, side, dim, avg(x) AS m, var_pop(x) AS s FROM x GROUP BY cluster, side, dim),
  r AS (SELECT cluster, sqrt(sum(s)) AS radius FROM d GROUP BY cluster),
  g AS (SELECT a.cluster AS p, b.cluster AS q, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS distance
        FROM d a JOIN d b USING (dim) WHERE NOT a.side AND b.side GROUP BY a.cluster, b.cluster),
  s AS (SELECT p, q, distance, (rp.radius + rq.radius) / distance AS affinity FROM g JOIN r rp ON rp.cluster = p JOIN r rq ON rq.cluster = q),
  pairs AS (SELECT *, percent_rank() OVER (ORDER BY affinity DESC, p, q) AS place FROM s)"""

_RATED = """rated AS (SELECT doc_id, coalesce(lang, '') AS lang, CAST(quality AS INT) AS a, CAST(n_chars >= 400 AS INT) AS b
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)"""


def _kappa_sql(cells: str) -> str:
    return f"""m AS (SELECT part, replicate, k.label AS label, sum(k.wa) AS wa, sum(k.wb) AS wb FROM (
      SELECT part, replicate, unnest([{{'label': a, 'wa': w, 'wb': 0}}, {{'label': b, 'wa': 0, 'wb': w}}]) AS k FROM {cells}) GROUP BY ALL),
  c AS (SELECT part, replicate, sum(wa::DOUBLE * wb) AS chance FROM m GROUP BY ALL),
  t AS (SELECT part, replicate, sum(w) AS n, sum(CASE WHEN a = b THEN w ELSE 0 END) AS same FROM {cells} GROUP BY ALL HAVING sum(w) > 0),
  k AS (SELECT part, replicate, n, same / n AS observed, chance / n / n AS expected,
        CASE WHEN chance / n / n < 1 THEN (same / n - chance / n / n) / (1 - chance / n / n) END AS kappa FROM t JOIN c USING (part, replicate))"""


_WEIGHT = " + ".join(f"(draw >= {t})::BIGINT" for t in ag.STEPS)

ORACLE = {
    "x1_class_clusters": """SELECT CAST(label >= 5 AS INT) AS side, count(*) AS n_rows, 0::BIGINT AS n_misplaced, 0::BIGINT AS n_off, TRUE AS several
      FROM embeddings GROUP BY label >= 5""",
    "x2_cluster_affinity": f"""WITH {_AFFINITY} SELECT p, q, round(distance, 6) AS distance, round(affinity, 6) AS affinity, round(place, 6) AS place,
      place <= {bd.KEPT_SHARE} AS kept FROM pairs""",
    "x3_boundary_pairs": f"""WITH {_AFFINITY}, near AS (
      SELECT p, q, a.id, b.id AS neighbour, list_distance(a.e, b.e) AS distance,
        row_number() OVER (PARTITION BY p, q, a.id ORDER BY list_distance(a.e, b.e), b.id) AS rank
      FROM pairs JOIN v a ON a.cluster = p JOIN v b ON b.cluster = q WHERE place <= {bd.KEPT_SHARE})
      SELECT p, q, id, CAST(rank AS INT) AS rank, neighbour, round(distance, 6) AS distance FROM near WHERE rank <= {bd.NEIGHBOURS}""",
    "x4_greedy_coverage": f"""WITH RECURSIVE cells AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY ALL),
  items AS MATERIALIZED (SELECT doc_id, (1.0::DOUBLE - abs(2.0::DOUBLE * (n_chars / (n_chars + 400.0::DOUBLE)) - 1.0::DOUBLE)) * (n / (SELECT max(n) FROM cells)) AS pr,
      coalesce('=' || d.lang, '') AS f1, coalesce('=' || d.source, '') AS f2, coalesce('=' || (n_chars // 100), '') AS f3
    FROM documents d JOIN cells c ON d.lang IS NOT DISTINCT FROM c.lang AND d.source IS NOT DISTINCT FROM c.source),
  pick AS (
    SELECT 0 AS step, 0::BIGINT AS doc_id, 0::DOUBLE AS gain, []::BIGINT[] AS ids, []::VARCHAR[] AS l1, []::VARCHAR[] AS l2, []::VARCHAR[] AS l3
    UNION ALL
    SELECT step + 1, b.id, -b.g, list_append(ids, b.id), list_append(l1, b.f1), list_append(l2, b.f2), list_append(l3, b.f3)
    FROM (SELECT p.step, p.ids, p.l1, p.l2, p.l3, min({{'g': -(i.pr * ((1.0::DOUBLE / (1 + len(list_filter(p.l1, lambda x: x = i.f1)))
        + 1.0::DOUBLE / (1 + len(list_filter(p.l2, lambda x: x = i.f2))) + 1.0::DOUBLE / (1 + len(list_filter(p.l3, lambda x: x = i.f3)))) / 3.0::DOUBLE)),
        'id': i.doc_id, 'f1': i.f1, 'f2': i.f2, 'f3': i.f3}}) AS b
      FROM pick p, items i WHERE p.step < {cv.BUDGET} AND i.pr >= 0 AND NOT list_contains(p.ids, i.doc_id) GROUP BY ALL))
  SELECT step, doc_id, round(gain, 10) AS gain FROM pick WHERE step > 0""",
    "x5_kappa_bootstrap": f"""WITH {_RATED}, draws AS (
      SELECT lang AS part, a, b, CAST(r AS INT) AS replicate,
        ('0x' || substr(md5((r // 4) || ':' || doc_id), 1 + 8 * (r % 4), 8))::UINTEGER::BIGINT AS draw
      FROM rated, range({ag.REPLICATES}) t(r)),
  cells AS (SELECT part, replicate, a, b, sum({_WEIGHT}) AS w FROM draws GROUP BY ALL
      UNION ALL SELECT lang, -1, a, b, count(*) FROM rated GROUP BY ALL),
  {_kappa_sql('cells')},
  ci AS (SELECT part, quantile_cont(kappa, 0.025) AS low, quantile_cont(kappa, 0.975) AS high FROM k WHERE replicate >= 0 GROUP BY part)
  SELECT part, n::BIGINT AS n, round(observed, 8) AS observed, round(expected, 8) AS expected, round(kappa, 8) AS kappa, round(low, 8) AS low,
    round(high, 8) AS high, coalesce(kappa >= {ag.GATE}, FALSE) AS passes FROM k JOIN ci USING (part) WHERE replicate = -1""",
    "x6_plateau": f"""WITH {_RATED}, placed AS (
      SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UINTEGER % {ROUNDS} + 1 AS round,
        ('0x' || substr(md5(doc_id::VARCHAR), 9, 8))::UINTEGER % 2 = 0 AS held_out FROM rated),
  cells AS (SELECT round AS part, -1 AS replicate, a, b, count(*) AS w FROM placed WHERE held_out GROUP BY ALL),
  {_kappa_sql('cells')},
  gains AS (SELECT part AS round, kappa, kappa - lag(kappa) OVER (ORDER BY part) AS gain FROM k),
  flats AS (SELECT *, coalesce(gain < {ag.EPSILON}, FALSE) AS flat FROM gains),
  ends AS (SELECT *, (flat AND coalesce(lag(flat) OVER (ORDER BY round), FALSE)) OR coalesce(kappa >= {ag.GATE}, FALSE) AS ends FROM flats)
  SELECT CAST(round AS INT) AS round, round(kappa, 8) AS kappa, round(gain, 8) AS gain, flat,
    coalesce(round = (SELECT min(round) FROM ends WHERE ends), FALSE) AS stop FROM ends""",
    "x7_structure": f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a, (embedding[1:16])::DOUBLE[] AS b FROM embeddings),
  d AS (SELECT q.id AS query, o.id, list_distance(q.a, o.a) AS x, list_distance(q.b, o.b) AS y FROM v q JOIN v o ON q.id % 100 = 0 AND q.id <> o.id),
  r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
      rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
      row_number() OVER (PARTITION BY query ORDER BY x, id) <= {st.NEIGHBOURS} AS na, row_number() OVER (PARTITION BY query ORDER BY y, id) <= {st.NEIGHBOURS} AS nb FROM d),
  o AS (SELECT query, count(*) FILTER (na AND nb) / count(*) FILTER (na) AS share FROM r GROUP BY query)
  SELECT (SELECT count(*) FROM d) AS pairs, (SELECT round(corr(rx, ry), 6) FROM r) AS spearman, count(*) AS queries, round(avg(share), 8) AS preservation FROM o""",
}
