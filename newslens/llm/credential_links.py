r"""Secret scan with linking of multipart credentials, DataFrame functions only.

Strong findings (the base kinds) stand alone. Weak candidates are parts that mean nothing by
themselves: an account name, a mixed blob, an address. They are reported only with their
complement in the same scope, ``SCOPE`` code points around them in the same text:

* ``identifier`` (``user=...``, ``client_id: ...``, ``DB_USER=...``, in any case and behind any prefix) with any secret part,
* ``blob`` (20 or more base64 characters with both cases and a digit) with an identifier or access key,
* ``endpoint`` (a URL) with both an identifier part and a secret part.

Two parts are in scope when they do not overlap and the gap between their intervals is at most ``SCOPE``, whatever
their lengths; a part is never its own complement. The interval join works on buckets of ``SCOPE`` code points: per text,
role and bucket the starts (and the ends) that lie in it are one row of positions, of which a bucket holds few, and a candidate
meets the buckets of its own end and start and the next one on each side, so a text full of parts makes no pairs.

A position is the sum of the lengths of all matches and gaps before it, in code points; it comes
from a window over the few matches of a text, never over its characters.

Defined results: a null or empty text has no findings. Matches that fail their length are dropped
and not tried again. Rows are told apart by id and text, repeated rows give repeated results. Only ``id_col``
and ``text`` are read. A text without findings digests the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.functions.scalars import let
from newslens.runtime import materialize

SCOPE = 200
# The base patterns and the least length of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
BASE = {
    # a look at the first letter spares the alternation; runs shorter than the least length never match
    "assign": r"(?=[pPsStTaA])" + ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
WEAK = {
    # as in "assign" the span begins at the keyword, whatever prefix stands before it
    "identifier": r"""(?=[uUlLaAcC])(?i:user(?:[_-]?(?:name|id))?|login|account(?:[_-]?(?:name|id))?|client[_-]?id|access[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""",
    "blob": r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{20,}",
    "endpoint": r"""https?://[^\x00-\x20"'<>]+""",
}
KINDS = [*BASE, *WEAK]
IDENTIFIERS, SECRETS = ("access", "identifier"), ("assign", "hex", "blob")


def _matches(text: Column, kind: str) -> Column:
    """``(kind, i, gap, len, valid)`` of every match: its length and that of the text before it since the last one."""
    pattern = (BASE | WEAK)[kind]
    none = F.array().cast("array<struct<kind:string,i:int,gap:bigint,len:bigint,valid:boolean>>")
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))

    def entry(gaps: Column):
        def of(match: Column, i: Column) -> Column:
            valid = F.length(F.regexp_extract(match, f"^{ASSIGN}$", 2)) >= ASSIGN_LEAST if kind == "assign" else F.lit(True)
            return F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                F.length(F.get(gaps, i)).cast("bigint").alias("gap"),
                F.length(match).cast("bigint").alias("len"),
                valid.alias("valid"),
            )

        return of

    entries = let(F.split(text, pattern), lambda gaps: F.transform(found, entry(gaps)))
    return F.when(text.rlike(pattern), entries).otherwise(none)


def parts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, kind, start, end)`` of all strong and weak parts, stored.

    ``key`` is the id with a hash of the text. One row per key has no kind; its ``end`` is the
    number of such rows in ``docs``, so texts without parts and repeated rows are not lost.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marker = F.array(
        F.struct(
            F.lit(None).cast("string").alias("kind"),
            F.lit(0).alias("i"),
            F.lit(0).cast("bigint").alias("gap"),
            F.lit(0).cast("bigint").alias("len"),
            F.lit(True).alias("valid"),
        )
    )
    rows = docs.select(
        F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")).alias("key"),
        F.explode(F.concat(marker, *[_matches(value, kind) for kind in KINDS])).alias("m"),
    )
    rows = rows.groupBy("key", "m.kind", "m.i").agg(
        F.first("m.gap").alias("gap"), F.first("m.len").alias("len"), F.first("m.valid").alias("valid"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).filter("valid")
    end = F.when(F.col("kind").isNull(), F.col("n")).otherwise(F.col("end"))
    return materialize(placed.select("key", "kind", (F.col("end") - F.col("len")).alias("start"), end.alias("end")), "secret-parts")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak rows of ``found`` that have their complement in scope."""
    bucket = lambda at: F.floor(at / scope)
    roles = {"identifier": IDENTIFIERS, "secret": SECRETS}
    side = lambda name, at: F.struct(F.lit(name).alias("side"), at.alias("at"))
    holders = found.filter(F.col("kind").isin(*IDENTIFIERS, *SECRETS))
    holders = holders.withColumn("x", F.explode(F.array(side("after", F.col("start")), side("before", F.col("end"))))).select("key", "kind", "x.*")
    places = holders.groupBy("key", "side", bucket(F.col("at")).alias("bucket")).agg(
        *[F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("at"))).alias(role) for role, kinds in roles.items()]
    )
    weak = found.filter(F.col("kind").isin(*WEAK))
    after, before = bucket(F.col("end")), bucket(F.col("start"))
    looks = [F.struct(F.lit(name).alias("side"), b.alias("bucket")) for name, b in (("after", after), ("after", after + 1), ("before", before), ("before", before - 1))]
    near = weak.withColumn("x", F.explode(F.array(*looks))).select("key", "kind", "start", "end", "x.*")
    # a complement begins at most a scope behind the end, or ends at most a scope before the start
    gap = lambda at: F.when(F.col("side") == "after", at - F.col("end")).otherwise(F.col("start") - at)
    met = near.join(places, ["key", "side", "bucket"])
    held = [F.max(F.exists(role, lambda at: gap(at).between(0, scope))).alias(role) for role in roles]
    roles = met.groupBy("key", "kind", "start", "end").agg(*held)
    wanted = {"identifier": ("secret",), "blob": ("identifier",), "endpoint": ("identifier", "secret")}
    complete = F.lit(False)
    for kind, needs in wanted.items():
        both = F.lit(True)
        for need in needs:
            both = both & F.col(need)
        complete = complete | ((F.col("kind") == kind) & both)
    return roles.filter(complete).select("key", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(key, kind, start, end)``: base findings, linked candidates, and the row without kind per key."""
    found = parts(docs, id_col, text)
    base = found.filter(F.col("kind").isNull() | F.col("kind").isin(*BASE))
    return base.unionByName(linked(found, scope))


def _digest_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, a row for each row of ``docs``."""
    number = F.lit(None).cast("int")
    for i, kind in enumerate(KINDS):
        number = F.when(F.col("kind") == kind, i).otherwise(number)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", number.alias("number"), "end", "kind"))
    grouped = find_secrets(docs, id_col, text, scope).groupBy("key").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind in BASE],
        F.sort_array(F.collect_list(span)).alias("every"),
        F.max(F.when(F.col("kind").isNull(), F.col("end"))).alias("n_rows"),
    )
    copies = grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    base = F.filter("every", lambda s: s["number"] < len(BASE))
    return copies.select(
        F.col("key.id").alias(id_col),
        *[f"n_{kind}" for kind in BASE],
        F.sha2(_digest_text(base), 256).alias("base_sha256"),
        _digest_text(F.col("every")).alias("spans"),
    )


def op2_query(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf}/documents.parquet"))


def _sql_matches(kind: str) -> str:
    pattern = {
        "assign": ASSIGN,
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
        "endpoint": WEAK["endpoint"],
    }[kind].replace("'", "''")
    least = {"assign": f"length(regexp_extract(m, '{pattern}', 2)) >= {ASSIGN_LEAST}", "access": "length(m) >= 18", "hex": "length(m) >= 16", "endpoint": "true"}[kind]
    return f"""SELECT doc_id, '{kind}' AS kind, e - length(m) AS s, e FROM (
  SELECT doc_id, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs[1 : len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM documents)))
WHERE {least}"""


# The supplied tables hold no identifiers and no access keys, so only base findings can be reported;
# the look-around patterns of the weak kinds are beyond the SQL engine and are tested by brute force.
ORACLE = f"""
WITH f AS ({" UNION ALL ".join(_sql_matches(kind) for kind in BASE)}),
k AS (SELECT *, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS number, kind || ':' || s || ':' || e AS word FROM f),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(word, ',' ORDER BY s, number) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""
